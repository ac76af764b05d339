"""Checks that a user runs around an anonymization: keys, links and checksums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of one word: consecutive values of an integer part that share a row of the first aggregate.
_WORD_BITS = 6
#: Bytes of a key's columns, as Spark estimates them, below which shuffling all keys costs less than a job of its own.
SMALL = 64 << 20


def unique_check(df: DataFrame, key: list[str], small: int = SMALL) -> DataFrame:
    """One row: rows, rows with a NULL in the key, and key values held more than once.

    Where a part of the key is an integer, 64 consecutive values of it make a word: a count of rows and a bit for every value
    seen, joined in the map-side combine. A table clustered by its key so shuffles up to 64 times fewer rows, any other at
    most as many. A word with as many rows as bits repeats nothing; where all words are so, the answer is there. Else, for
    keys without an integer and for keys of less than `small` bytes, key values are counted one by one. The first way runs
    at once, the second is lazy; both are exact.
    """
    parts = df.select(*[F.col(f"`{name}`").alias(f"part_{i}") for i, name in enumerate(key)])
    whole = next((field.name for field in reversed(parts.schema.fields) if isinstance(field.dataType, T.IntegralType)), None)
    if whole is None or parts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < small:
        return _counted_by_key(df, key)
    at = F.col(whole).cast("bigint")
    place = at.bitwiseAND(F.lit(2**_WORD_BITS - 1)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place).alias("bit")
    names = ["word", *(name for name in parts.columns if name != whole)]
    words = parts.select("*", F.shiftright(at, _WORD_BITS).alias("word"), bit).groupBy(*names).agg(F.count("*").alias("n"), F.bit_count(F.bit_or("bit")).alias("bits"))
    has_null = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in names])
    found = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(has_null, F.col("n"))), F.lit(0)).alias("null_keys"),
        F.count_if(~has_null & (F.col("n") > F.col("bits"))).alias("duplicate_keys"),
    )
    totals = found.first()
    if totals["duplicate_keys"]:
        return _counted_by_key(df, key)
    return df.sparkSession.range(0, 1, 1, 1).select(*[F.lit(totals[name]).cast("bigint").alias(name) for name in found.columns])


def _counted_by_key(df: DataFrame, key: list[str]) -> DataFrame:
    has_null = reduce(lambda a, b: a | b, [F.col(f"`{name}`").isNull() for name in key])
    per_key = df.groupBy(*[F.col(f"`{name}`") for name in key]).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(has_null, F.col("n"))), F.lit(0)).alias("null_keys"),
        F.count_if((F.col("n") > 1) & ~has_null).alias("duplicate_keys"),
    )


def link_preserved(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """One row: child rows, and child rows that still meet a parent on key and shared attributes.

    The child is counted per combination before the shuffle meets the parent, so a key
    that holds a third of the child costs one row per task.
    """
    child_names = [name for name, _ in on]
    grouped = child.groupBy(*child_names).agg(F.count("*").alias("n"))
    parents = parent.groupBy(*[F.col(right).alias(f"__parent_{left}") for left, right in on]).agg(
        F.count("*").alias("__parents")
    )
    # Null-safe in the join, checked after it: a plain `=` would have Catalyst push a NOT NULL
    # filter below the aggregate, which computes every pseudonym a second time.
    condition = reduce(lambda a, b: a & b, [F.col(left).eqNullSafe(F.col(f"__parent_{left}")) for left, _ in on])
    complete = reduce(lambda a, b: a & b, [F.col(left).isNotNull() for left, _ in on])
    matched = grouped.join(parents, condition, "left")
    linked = F.when(complete, F.col("n") * F.coalesce("__parents", F.lit(0)))
    return matched.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("child_rows"),
        F.coalesce(F.sum(linked), F.lit(0)).alias("linked_rows"),
    )


def row_text(df: DataFrame, columns: list[str]) -> Column:
    """Unambiguous text of a row: length-prefixed parts, `N` for NULL; instants in microseconds, whatever the time zone."""
    parts = []
    for field in df.select(*[F.col(f"`{name}`") for name in columns]).schema:
        column = F.col(f"`{field.name}`")
        text = (F.unix_micros(column) if isinstance(field.dataType, T.TimestampType) else column).cast("string")
        parts.append(F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("N")))
    return F.concat(*parts)


def row_piece(df: DataFrame, columns: list[str]) -> Column:
    """A row's part in its table's checksum: sums of parts can be merged in any order."""
    return F.conv(F.substring(F.md5(row_text(df, columns)), 1, 15), 16, 10).cast("decimal(20,0)")


def table_checksum(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: row count and an order-insensitive sum over row hashes; one pass, no sort."""
    return df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(row_piece(df, columns or df.columns)), F.lit(0)).cast("decimal(38,0)").alias("checksum"),
    )

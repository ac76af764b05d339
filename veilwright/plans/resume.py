"""Chunked, resumable rewriting of one table.

A stored table's chunks are packs of whole files with about as many rows as a number of pages: no byte is read by two
chunks, whatever the key, and partition columns and formats stay as they are. Files are counted and packed by a Spark job
and the plan is a table; the driver gets the numbers of the chunks, and one chunk's file names at a time. Rows that come from
no file are cut by key: ranges suit a single ordered key, parts by the key's hash every other one; each such chunk reads the
whole input, so there should be few.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from decimal import Decimal
from typing import Callable, NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PolicyError, SchemaError
from ..operators.apply import TOUCHED, VIOLATIONS, quote_identifier
from ..operators.checks import row_piece, table_checksum
from .progress import Manifest, ProgressKey

_BOUNDARY_ACCURACY = 10000
#: Pages of one chunk; packs that one task makes (its files are put in order, others' are not).
PAGES, PACKS = 200, 64
_PACKED = "chunk int, file string, rows bigint"
_ORDERED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Chunk:
    """`rule` is all, range (lower < key <= upper), hash (of the key), files (hash of a row's file) or packed.

    A packed chunk's files are the rows of the table `lower` names that bear its index.
    """

    index: int
    rule: str = "all"
    parts: int = 1
    lower: str | None = None
    upper: str | None = None

    def rows(self, df: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
        """The chunk's rows. Rows whose key is NULL belong to the first range."""
        columns = [F.col(quote_identifier(name)) for name in key]
        if self.rule == "hash":
            return df.where(F.pmod(F.xxhash64(*columns), F.lit(self.parts)) == self.index)
        if self.rule == "files":
            # Spark tries a predicate over file metadata on the file list, so other files are not opened.
            return df.where(F.pmod(F.xxhash64(F.col("_metadata.file_path")), F.lit(self.parts)) == self.index)
        if self.rule == "packed":
            mine = df.sparkSession.read.schema(_PACKED).parquet(self.lower).where(F.col("chunk") == self.index)
            return df.where(F.col("_metadata.file_path").isin([row["file"] for row in mine.collect()]))
        if self.rule == "range":
            kind = df.schema[key[0]].dataType
            above = F.lit(True) if self.lower is None else columns[0] > _bound(self.lower, kind)
            below = F.lit(True) if self.upper is None else columns[0] <= _bound(self.upper, kind)
            inside = above & below
            return df.where(inside | columns[0].isNull() if self.lower is None else inside)
        return df


def _bound(text: str, kind: T.DataType) -> Column:
    """A recorded bound, whatever the session's time zone: instants are kept as microseconds."""
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(int(text)))
    return F.lit(text).cast(kind)


def key_chunks(df: DataFrame, key: tuple[str, ...], count: int) -> list[Chunk]:
    """Up to `count` chunks of about equal row counts over the key."""
    if count <= 1:
        return [Chunk(0)]
    kind = df.schema[key[0]].dataType
    if len(key) > 1 or not isinstance(kind, _ORDERED):
        return [Chunk(i, "hash", count) for i in range(count)]
    column = F.col(quote_identifier(key[0]))
    if isinstance(kind, T.TimestampType):
        column = F.unix_micros(column)
    shares = F.array(*[F.lit(i / count) for i in range(1, count)])
    found = df.agg(F.percentile_approx(column, shares, _BOUNDARY_ACCURACY).cast("array<string>").alias("cuts")).first()["cuts"]
    edges = [None, *dict.fromkeys(found or []), None]
    return [Chunk(i, "range", len(edges) - 1, low, high) for i, (low, high) in enumerate(zip(edges, edges[1:]))]


def file_chunks(df: DataFrame, count: int) -> list[Chunk]:
    """`count` groups of the table's files, or the whole table where rows come from no file."""
    try:
        df.select("_metadata.file_path")
    except AnalysisException:
        count = 1
    return [Chunk(0)] if count <= 1 else [Chunk(i, "files", count) for i in range(count)]


def from_files(df: DataFrame) -> bool:
    """Do all rows come from files that are read as they are?"""
    try:
        df.select("_metadata.file_path")
    except AnalysisException:
        return False
    return True


def packed_chunks(df: DataFrame, plan: str, size: int | None = None, count: int | None = None) -> list[Chunk]:
    """Chunks of whole files with about `size` rows each, or about `count` of them; the plan is written to `plan`.

    Row counts come from the files' footers where the format has them. A file with more rows is a chunk by itself.
    """
    files = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
    counted = f"{plan}/files"
    files.write.mode("overwrite").parquet(counted)
    files = df.sparkSession.read.parquet(counted)
    total = files.agg(F.sum("rows")).first()[0] or 0
    size = size or max(1, -(-total // (count or 1)))
    groups = max(1, -(-total // (size * PACKS)))
    mine = Window.partitionBy("group").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    packed = files.withColumn("group", F.pmod(F.xxhash64("file"), F.lit(groups))).withColumn(
        "pack", F.floor(F.coalesce(F.sum("rows").over(mine), F.lit(0)) / F.lit(size)))
    # Packs of a group are counted on from the group's first number; there are PACKS or one more of them, by and large.
    numbered = packed.select((F.col("group") * F.lit(8 * PACKS) + F.col("pack")).cast("int").alias("chunk"), "file", "rows")
    if groups > 1 and packed.agg(F.max("pack")).first()[0] >= 8 * PACKS:
        raise PolicyError("a group of files is far larger than the others; choose larger pages")
    place = f"{plan}/packed"
    numbered.write.mode("overwrite").parquet(place)
    numbers = df.sparkSession.read.schema(_PACKED).parquet(place).select("chunk").distinct().orderBy("chunk").collect()
    # A table without files, or without rows, is one chunk.
    return [Chunk(row["chunk"], "packed", len(numbers), place) for row in numbers] or [Chunk(0)]


def run_chunks(
    df: DataFrame,
    rewrite: Callable[[DataFrame], DataFrame],
    chunks: Callable[[], list[Chunk]],
    manifest: Manifest,
    progress_key: ProgressKey,
    output: str,
    key: tuple[str, ...] = (),
    layout: tuple = (),
    checksums: bool = False,
) -> int:
    """Rewrite every chunk not committed yet; return the rows selected over all chunks.

    `rewrite` returns the marked rows of `transform(..., mark=True)`. Counting and
    checking happen in the pass that writes. Chunks are fixed by the first run and read
    back by later ones. `layout` is the format and the partition columns to write with. With `checksums` each chunk's commit
    holds the checksum of the rows written, taken in the same pass; `merged_checksum` adds them up.

    Two drivers of one run do not write to one place: the first to take a chunk writes to the chunk's folder, any other
    to one of its own, and readers settle on one commit a chunk. Both hold the same rows.
    """
    plan, finished = _planned(manifest, progress_key, chunks)
    done = {row["chunk"]: row["rows_done"] for row in finished}
    for chunk in plan:
        if chunk.index not in done:
            path = f"{output}/chunk={chunk.index}"
            if not manifest.claim(progress_key, f"chunk {chunk.index}"):
                path = f"{path}-{uuid.uuid4().hex}"
            rewritten, state = rewrite(chunk.rows(df, key)), {}
            if checksums:
                rewritten, seen = _summed(rewritten, df.columns)
            done[chunk.index] = write_checked(rewritten, path, *layout)
            if checksums:
                state = {"rows": seen.get["rows"], "checksum": seen.get["checksum"] or Decimal(0)}
            manifest.append(progress_key, chunk=chunk.index, rows_done=done[chunk.index], path=path, **state)
    return sum(done.values())


def _planned(manifest: Manifest, progress_key: ProgressKey, chunks: Callable[[], list[Chunk]]) -> tuple[list[Chunk], list[Row]]:
    """The chunks that the first run fixed, made now if there are none, and the commits there are."""
    recorded = manifest.entries(progress_key)
    plan = sorted((_chunk_of(row) for row in recorded if not row["done"]), key=lambda chunk: chunk.index)
    if not plan:
        plan = chunks()
        manifest.append_all(progress_key, [
            {"chunk": c.index, "rule": c.rule, "parts": c.parts, "lower": c.lower, "upper": c.upper, "done": False}
            for c in plan
        ])
    return plan, [row for row in recorded if row["done"]]


def _summed(marked: DataFrame, columns: list[str]) -> tuple[DataFrame, Observation]:
    """The same rows, whose count and checksum are observed as they are written."""
    seen = Observation()
    return marked.observe(seen, F.count("*").alias("rows"), F.sum(row_piece(marked, columns)).alias("checksum")), seen


def prove_chunks(
    df: DataFrame, chunks: Callable[[], list[Chunk]], manifest: Manifest, progress_key: ProgressKey, key: tuple[str, ...] = (),
) -> None:
    """Record the checksum of every chunk of a table that has none yet; nothing of the table is written.

    The key's kind is `proof`. A proof that was interrupted goes on with the chunks that are open, and `merged_checksum` gives
    the whole table's value. Two proofs, such as before and after a dry run, are two run uids.
    """
    plan, finished = _planned(manifest, progress_key, chunks)
    done = {row["chunk"] for row in finished}
    for chunk in plan:
        if chunk.index not in done:
            state = table_checksum(chunk.rows(df, key), df.columns).first()
            manifest.append(progress_key, chunk=chunk.index, rows=state["rows"], checksum=state["checksum"])


class Checksum(NamedTuple):
    rows: int
    checksum: Decimal


def merged_checksum(manifest: Manifest, progress_key: ProgressKey) -> Checksum:
    """Row count and checksum of a finished table, added up from its chunks' commits: no row is read again.

    Equals `table_checksum` over all rows. A chunk that two drivers committed counts once: they wrote the same rows.
    """
    recorded = manifest.entries(progress_key)
    states = {row["chunk"]: (row["rows"], row["checksum"]) for row in recorded if row["done"]}
    missing = {row["chunk"] for row in recorded if not row["done"]} - set(states)
    if missing or not states:
        raise PolicyError(f"the table is not finished: {len(missing) or 'all'} chunks are missing")
    if any(total is None for _, total in states.values()):
        raise PolicyError("the table's chunks were written without checksums")
    return Checksum(sum(rows for rows, _ in states.values()), sum((total for _, total in states.values()), Decimal(0)))


def _chunk_of(row) -> Chunk:
    return Chunk(row["chunk"], row["rule"], row["parts"], row["lower"], row["upper"])


def write_checked(marked: DataFrame, path: str, fmt: str = "parquet", partitions: tuple[str, ...] = ()) -> int:
    """Write marked rows and count them in the same pass; fail before anything is committed."""
    names = [field.name for field in marked.schema[VIOLATIONS].dataType.fields]
    bad = F.greatest(*[F.col(f"{VIOLATIONS}.`{n}`") for n in names], F.lit(False))
    seen = Observation()
    observed = marked.observe(
        seen, F.count_if(F.col(TOUCHED)).alias("selected"), F.count_if(bad).alias("bad")
    )
    observed.drop(TOUCHED, VIOLATIONS).write.mode("overwrite").format(fmt).partitionBy(*partitions).save(path)
    counts = seen.get
    if counts.get("bad", 0):
        raise SchemaError("replacement does not fit its column")
    return counts.get("selected", 0) or 0


def committed(manifest: Manifest, progress_key: ProgressKey, layout: tuple = (), schema: T.StructType | None = None) -> DataFrame:
    """The rows of a finished table: every planned chunk must be committed. `layout` and `schema` are the input's."""
    recorded = manifest.entries(progress_key)
    commits = sorted((row for row in recorded if row["done"]), key=lambda row: (row["updated_at"].timestamp(), row["path"] or ""), reverse=True)
    done = {row["chunk"]: row["path"] for row in commits}  # the earliest of a chunk's commits stays
    missing = {row["chunk"] for row in recorded if not row["done"]} - set(done)
    if missing or not done:
        raise PolicyError(f"the table is not finished: {len(missing) or 'all'} chunks are missing")
    paths = [done[index] for index in sorted(done)]
    fmt, partitions = (*layout, ())[:2] if layout else ("parquet", ())
    reader = manifest.spark.read.format(fmt)
    if schema is not None and layout:
        reader = reader.schema(schema)
    if not partitions:
        return reader.load(paths)
    # From the folder above, so that partition folders are read as such; the chunk's own folder then is one as well.
    root = paths[0].rsplit("/chunk=", 1)[0]
    found = reader.option("basePath", root).load(paths).drop("chunk")
    return found.select(*schema.names) if schema is not None else found


def pending_chunks(planned: DataFrame, finished: DataFrame, key: list[str]) -> DataFrame:
    """Planned units of work that no committed row covers."""
    return planned.join(finished.select(*key).distinct(), key, "left_anti")

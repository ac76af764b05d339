"""Replace policy columns of one table: a DataFrame in, a DataFrame out, no shuffle."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..functions.digest import Keyring, consistent_payload, keyed_digest, retry_digest, row_payload
from ..functions.text import input_text, nfc, pk_json, trim
from ..plans.rules import Rule
from ..plans.schema import ColumnInfo, violation
from . import strategies

TOUCHED = "__touched"
VIOLATIONS = "__violations"
_IDENTIFIER = re.compile(r"[A-Za-z0-9_$]{1,64}")


def quote_identifier(name: str) -> str:
    if not _IDENTIFIER.fullmatch(name):
        raise SchemaError("a name is outside the supported identifier alphabet")
    return f"`{name}`"


@dataclass(frozen=True)
class TableTransform:
    """Everything needed to rewrite one table."""

    database: str
    table: str
    rules: tuple[Rule, ...]
    columns: tuple[ColumnInfo, ...]  # one per rule, in rule order
    primary_key: tuple[ColumnInfo, ...] = ()
    ignore_where: str | None = None
    unique: tuple[tuple[str, ...], ...] = ()

    def check(self) -> None:
        """Identifiers, no duplicate columns, and the key is never a target."""
        for name in (self.database, self.table):
            quote_identifier(name)
        seen: set[str] = set()
        for info in (*self.primary_key, *self.columns):
            quote_identifier(info.name)
            if info.name.lower() in seen:
                raise SchemaError("a key column is a target, or a column is named twice")
            seen.add(info.name.lower())
        if not self.rules:
            raise SchemaError("there are no column rules")
        if not self.primary_key and any(rule.needs_row_identity for rule in self.rules):
            raise SchemaError("TableWithoutPrimaryKey: rows cannot be identified without a declared key")


def touched(ignore_where: str | None) -> Column:
    """True for rows a policy selects. An unknown (NULL) predicate protects the row."""
    if not ignore_where:
        return F.lit(True)
    return F.coalesce(F.expr(f"NOT ({ignore_where})"), F.lit(False))


def _handled(rule: Rule, info: ColumnInfo, text: Column) -> Column:
    """True where the value is replaced rather than kept by onNull / onEmpty."""
    null_handled = F.lit(rule.on_null == "Generate")
    if not info.textual or rule.on_empty == "Generate":
        present = F.lit(True)
    else:
        present = text != ""
    return F.when(F.col(quote_identifier(info.name)).isNull(), null_handled).otherwise(present)


def _stored(info: ColumnInfo, value: Column) -> Column:
    if info.family == "text":
        return value.cast("string")
    if info.family == "binary":
        return value.cast("string").cast("binary")
    return value.try_cast(info.data_type)


def _with(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns) if columns else df


def transform(
    df: DataFrame,
    plan: TableTransform,
    keyring: Keyring,
    retry: str | None = None,
    mark: bool = False,
    attempts: range | None = None,
) -> DataFrame:
    """Rewrite the policy columns of `df`; every other column and row is carried through.

    A chain of narrow projections, each making once what the next uses more than once:
    trimmed text, normal form, digest, its numeric stages, formatted value. `retry` names
    a column with the UNIQUE attempt of each row. `mark` keeps two extra columns: whether
    the row was selected, and one flag per rule for a value the column cannot hold.
    `attempts` gives every row once per attempt, all from one digest, and adds `retry`.
    """
    names = df.columns
    staged = df.withColumn(TOUCHED, touched(plan.ignore_where))
    key_text = pk_json([(F.col(quote_identifier(c.name)), c.data_type) for c in plan.primary_key])
    keyed = [i for i, rule in enumerate(plan.rules) if rule.keyed]
    linked = [i for i in keyed if plan.rules[i].consistent]

    texts = [
        F.coalesce(input_text(F.col(quote_identifier(info.name)), info.data_type), F.lit("")) for info in plan.columns
    ]
    guards = [
        F.col(TOUCHED) & _handled(rule, info, text) for rule, info, text in zip(plan.rules, plan.columns, texts)
    ]
    # Values that are kept turn NULL here, so they cost no hashing.
    staged = _with(staged, {f"__text_{i}": F.when(guards[i], trim(texts[i])) for i in linked})
    staged = _with(staged, {f"__norm_{i}": nfc(F.col(f"__text_{i}")) for i in linked})
    payloads = {}
    for i in keyed:
        rule, info = plan.rules[i], plan.columns[i]
        if rule.consistent:
            clean = F.col(f"__norm_{i}")
            payloads[i] = consistent_payload(rule.strategy, F.lower(clean) if rule.strategy == "email" else clean)
        else:
            payloads[i] = F.when(
                guards[i], row_payload(plan.database, plan.table, key_text, info.name)
            )
    staged = _with(staged, {f"__digest_{i}": keyed_digest(keyring, payloads[i]) for i in keyed})
    if attempts:
        staged = staged.withColumn(retry, F.explode(F.array(*[F.lit(i) for i in attempts])))
    if retry:
        again = {f"__digest_{i}": retry_digest(keyring, F.col(f"__digest_{i}"), F.col(retry)) for i in keyed}
        staged = _with(staged, again)

    chains = {i: strategies.stages(plan.rules[i], keyring) for i in keyed}
    extras: dict[int, list[Column]] = {}
    for level in range(max((len(chain) for chain in chains.values()), default=0)):
        made: dict[str, Column] = {}
        for i, chain in chains.items():
            if level < len(chain):
                values = chain[level](F.col(f"__digest_{i}"), extras.get(i, []))
                labels = [f"__stage_{i}_{level}_{j}" for j in range(len(values))]
                made.update(zip(labels, values))
                extras[i] = [F.col(label) for label in labels]
        staged = _with(staged, made)

    replaced: dict[str, Column] = {}
    flags: list[Column] = []
    for i, (rule, info) in enumerate(zip(plan.rules, plan.columns)):
        digest = F.col(f"__digest_{i}") if rule.keyed else F.lit(None)
        value = strategies.generated(rule, texts[i], digest, extras.get(i, []), keyring)
        original = F.col(quote_identifier(info.name))
        # A NULL needs no text form, so it fits columns of every type.
        stored = F.lit(None).cast(info.data_type) if rule.strategy == "null" else _stored(info, value)
        replaced[info.name] = F.when(guards[i], stored).otherwise(original).cast(info.data_type)
        if mark:
            kept_null = F.col(TOUCHED) & original.isNull() & F.lit(not info.nullable)
            bad = F.when(guards[i], violation(value.cast("string"), info)).otherwise(kept_null)
            flags.append(F.coalesce(bad, F.lit(False)).alias(info.name))
    output = [replaced[n].alias(n) if n in replaced else F.col(f"`{n}`") for n in names if n != retry]
    if mark:
        output += [F.col(TOUCHED), F.struct(*flags).alias(VIOLATIONS)]
    if attempts:
        output.append(F.col(retry))
    return staged.select(*output)


def violation_counts(df: DataFrame, plan: TableTransform, keyring: Keyring) -> DataFrame:
    """One row: selected rows, and per rule how many replacements do not fit. One pass."""
    marked = transform(df, plan, keyring, mark=True)
    return marked.agg(
        F.count_if(F.col(TOUCHED)).alias("rows_selected"),
        *[F.count_if(F.col(f"{VIOLATIONS}.{info.name}")).alias(f"bad_{info.name}") for info in plan.columns],
    )


def after_cursor(key: tuple[str, ...], cursor: tuple) -> Column:
    """Row-value comparison (k1, k2, ...) > (v1, v2, ...), written so that parquet can prune on k1."""
    if len(key) != len(cursor):
        raise SchemaError("the cursor does not have the key's shape")
    names = [F.col(quote_identifier(name)) for name in key]
    beyond = F.lit(False)
    for depth in reversed(range(len(key))):
        here = names[depth] > F.lit(cursor[depth])
        beyond = here if depth == len(key) - 1 else here | ((names[depth] == F.lit(cursor[depth])) & beyond)
    if len(key) > 1:
        beyond = (names[0] >= F.lit(cursor[0])) & beyond
    return beyond


def page_after(df: DataFrame, key: tuple[str, ...], size: int, cursor: tuple | None = None) -> DataFrame:
    """The next `size` rows in key order: each task keeps its own smallest rows, no global sort."""
    rows = df if cursor is None else df.where(after_cursor(key, cursor))
    return rows.orderBy(*[F.col(quote_identifier(name)) for name in key]).limit(size)

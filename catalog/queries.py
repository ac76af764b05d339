"""Registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright import Run, RunOptions, Tables, transform, violation_counts
from veilwright.functions import digest, text
from veilwright.operators import apply, checks, ledger
from veilwright.operators.unique import RETRY, resolve_unique, transform_unique
from veilwright.plans import resume
from veilwright.plans.progress import Manifest, ProgressKey
from veilwright.plans.rules import compile_rule
from veilwright.plans.runner import run_totals as totals_of_run
from veilwright.plans.steps import run_step, run_steps
from veilwright.sources import dataset, documents, fixtures
from veilwright.sources.scratch import scratch_path, written
from veilwright.streaming.apply_stream import apply_policy_stream, start_checked, start_to_files

from . import demo
from .demo import KEYRING, POLICY_HASH, REFERENCE_DATE, SEED, load, plan_for

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


rewritten = transform


# --- keyed digests ------------------------------------------------------------------------


@query
def value_hash_consistent(spark, sf_dir):
    df = load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value"))
    return rewritten(df, plan_for(df, "documents", [{"name": "value", "strategy": "hash"}]), KEYRING)


@query
def value_hash_row(spark, sf_dir):
    df = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("value"))
    rule = {"name": "value", "strategy": "hash", "consistent": False}
    return rewritten(df, plan_for(df, "conversations", [rule], ["conv_id", "turn"]), KEYRING)


@query
def value_hash_row_text_key(spark, sf_dir):
    df = load(spark, sf_dir, "customer").select("c_name", "c_custkey", F.col("c_mktsegment").alias("value"))
    rule = {"name": "value", "strategy": "hash", "consistent": False}
    return rewritten(df, plan_for(df, "customer", [rule], ["c_name", "c_custkey"]), KEYRING)


@query
def retry_hash(spark, sf_dir):
    df = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("value"))
    df = df.withColumn(RETRY, (F.col("o_orderkey") % 8).cast("int")).withColumn("attempt", F.col(RETRY))
    rule = {"name": "value", "strategy": "hash", "consistent": False}
    return rewritten(df, plan_for(df, "orders", [rule], ["o_orderkey"]), KEYRING, retry=RETRY)


@query
def digest_mod(spark, sf_dir):
    payload = F.col("l_orderkey").cast("string").cast("binary")
    df = load(spark, sf_dir, "lineitem").select("l_orderkey", digest.keyed_digest(KEYRING, payload).alias("h"))
    words = [F.col(f"w{i}") for i in range(4)]
    df = df.withColumns({f"w{i}": w for i, w in enumerate(digest.digest_words(F.col("h")))})
    moduli = {"mod_101": 101, "mod_e9": 10**9, "mod_e18": 10**18}
    df = df.withColumns({f"odd_{name}": digest.odd_residue(words, m) for name, m in moduli.items()})
    df = digest.with_low_digits(df, "h", 33, "low_33")
    return df.select(
        "l_orderkey",
        *[digest.join_residue(words, F.col(f"odd_{name}"), m).alias(name) for name, m in moduli.items()],
        digest.wide_mod(F.col("h"), 2**64).alias("mod_2_64"),
        F.regexp_replace("low_33", "^0+(?=.)", "").alias("mod_e33"),
    )


@query
def digits_33(spark, sf_dir):
    """Codes of 33 places, and numbers from a span of odd size above 2**62: no Python in either."""
    df = load(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("code"), F.col("o_orderpriority").alias("amount"))
    columns = [
        {"name": "code", "strategy": "digits", "params": {"length": 33}},
        {"name": "amount", "strategy": "number", "params": {"min": 0, "max": 2**62 + 2}},
    ]
    return rewritten(df, plan_for(df, "orders", columns, ["o_orderkey"]), KEYRING)


@query
def digits_78(spark, sf_dir):
    """Codes of all the 78 places that a digest has, and of more, which begin with zeros."""
    df = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("code"), F.col("o_orderpriority").alias("longer"))
    columns = [{"name": "code", "strategy": "digits", "params": {"length": 78}}, {"name": "longer", "strategy": "digits", "params": {"length": 90}}]
    return rewritten(df, plan_for(df, "orders", columns, ["o_orderkey"]), KEYRING)


@query
def hash_binary(spark, sf_dir):
    """The documents' bytes from odd places on, so that many are no UTF-8; text cut the same way beside them."""
    raw = F.expr("substring(cast(text as binary), 2 + cast(pmod(doc_id, 7) as int))")
    df = load(spark, sf_dir, "documents").select("doc_id", raw.alias("value"))
    out = rewritten(df, plan_for(df, "documents", [{"name": "value", "strategy": "hash"}], ["doc_id"]), KEYRING)
    return out.select("doc_id", F.col("value").cast("string").alias("value"))


@query
def nfc_trim(spark, sf_dir):
    df = load(spark, sf_dir, "documents")
    lead = F.lit("  　\t")
    variant = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(lead, F.col("text"), F.lit("\n ")))
        .when(F.col("doc_id") % 3 == 1, F.replace(F.col("text"), F.lit("e"), F.lit("é")))
        .otherwise(F.col("text"))
    )
    return df.select("doc_id", F.sha2(text.nfc_trim(variant), 256).alias("digest"))


# --- predicates and value handling --------------------------------------------------------

VARIANTS = (
    "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN '' WHEN c_custkey % 7 = 2 THEN '   ' "
    "ELSE c_name END"
)


def _variants(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", F.expr(VARIANTS).alias("value"))


@query
def apply_table(spark, sf_dir):
    df = load(spark, sf_dir, "customer")
    columns = [
        {"name": "c_name", "strategy": "hash", "params": {"length": 24}},
        {"name": "c_mktsegment", "strategy": "constant", "params": {"value": "SEGMENT"}},
        {"name": "c_acctbal", "strategy": "number", "params": {"min": -999, "max": 9999}},
    ]
    return rewritten(df, plan_for(df, "customer", columns, ["c_custkey"], where="c_nationkey = 3"), KEYRING)


@query
def ignore_where(spark, sf_dir):
    df = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    rule = {"name": "o_orderstatus", "strategy": "constant", "params": {"value": "X"}}
    where = "nullif(o_orderpriority, '5-LOW') = '1-URGENT'"
    return rewritten(df, plan_for(df, "orders", [rule], ["o_orderkey"], where=where), KEYRING)


@query
def on_null(spark, sf_dir):
    df = _variants(spark, sf_dir).withColumn("kept", F.col("value"))
    columns = [
        {"name": "value", "strategy": "hash", "onNull": "Generate"},
        {"name": "kept", "strategy": "constant", "params": {"value": "C"}},
    ]
    return rewritten(df, plan_for(df, "customer", columns), KEYRING)


@query
def on_empty(spark, sf_dir):
    df = _variants(spark, sf_dir).withColumn("kept", F.col("value"))
    columns = [
        {"name": "value", "strategy": "phone", "onEmpty": "Generate"},
        {"name": "kept", "strategy": "mask"},
    ]
    return rewritten(df, plan_for(df, "customer", columns), KEYRING)


@query
def keyset_predicate(spark, sf_dir):
    df = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return df.where(apply.after_cursor(("conv_id", "turn"), (10, 1)))


@query
def pk_page(spark, sf_dir):
    """One page of a composite key after a cursor; the page size is the feature."""
    df = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return apply.page_after(df, ("conv_id", "turn"), 50, (7, 2))


# --- the strategies -----------------------------------------------------------------------

# name -> (table, key column, source column, params)
STRATEGY_INPUTS = {
    "firstName": ("customer", "c_custkey", "c_name", {}),
    "lastName": ("customer", "c_custkey", "c_name", {}),
    "fullName": ("customer", "c_custkey", "c_name", {}),
    "jobTitle": ("customer", "c_custkey", "c_name", {}),
    "email": ("customer", "c_custkey", "c_name", {}),
    "phone": ("orders", "o_orderkey", "o_orderpriority", {"digits": 12}),
    "date": ("customer", "c_custkey", "c_name", {}),
    "address": ("customer", "c_custkey", "c_name", {}),
    "streetAddress": ("customer", "c_custkey", "c_name", {}),
    "streetSuffix": ("customer", "c_custkey", "c_name", {}),
    "city": ("customer", "c_custkey", "c_name", {}),
    "postalCode": ("customer", "c_custkey", "c_name", {}),
    "state": ("customer", "c_custkey", "c_name", {}),
    "country": ("customer", "c_custkey", "c_name", {}),
    "company": ("customer", "c_custkey", "c_name", {}),
    "companySuffix": ("customer", "c_custkey", "c_name", {}),
    "vatId": ("supplier", "s_suppkey", "s_name", {}),
    "iban": ("customer", "c_custkey", "c_name", {}),
    "ipv4Public": ("customer", "c_custkey", "c_name", {}),
    "url": ("pages", "page_id", "url", {}),
    "uuid": ("customer", "c_custkey", "c_name", {}),
    "alphanumeric": ("orders", "o_orderkey", "o_orderpriority", {"length": 20, "case": "Upper"}),
    "digits": ("orders", "o_orderkey", "o_orderpriority", {"length": 12}),
    "number": ("orders", "o_orderkey", "o_custkey", {"min": -50, "max": 1000000}),
    "text": ("customer", "c_custkey", "c_name", {"sentences": 2, "maxLength": 100}),
    "constant": ("part", "p_partkey", "p_brand", {"value": "BRAND"}),
    "hash": ("customer", "c_custkey", "c_name", {"encoding": "base64"}),
    "mask": ("part", "p_partkey", "p_name", {"keepPrefix": 2, "keepSuffix": 1, "maskChar": "#"}),
    "null": ("events", "event_id", "props", {}),
}


def _strategy_query(name):
    def build(spark, sf_dir):
        table, key, source, params = STRATEGY_INPUTS[name]
        df = load(spark, sf_dir, table).select(key, F.col(source).alias("value"))
        rule = {"name": "value", "strategy": name, **({"params": params} if params else {})}
        return rewritten(df, plan_for(df, table, [rule], [key]), KEYRING)

    build.__name__ = name
    return build


for _name in STRATEGY_INPUTS:
    QUERIES[_name] = _strategy_query(_name)


@query
def email_domain(spark, sf_dir):
    df = load(spark, sf_dir, "customer").select("c_custkey", F.upper("c_name").alias("value"))
    rule = {"name": "value", "strategy": "email", "params": {"domain": "example.com"}}
    return rewritten(df, plan_for(df, "customer", [rule]), KEYRING)


@query
def date_datetime(spark, sf_dir):
    df = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    rule = {"name": "o_orderdate", "strategy": "date", "consistent": False,
            "params": {"from": "2001-02-03", "to": "2004-05-06", "format": "datetime"}}
    return rewritten(df, plan_for(df, "orders", [rule], ["o_orderkey"]), KEYRING)


@query
def date_consistent(spark, sf_dir):
    df = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    rule = {"name": "o_orderdate", "strategy": "date", "params": {"from": "2001-02-03", "to": "2004-05-06"}}
    return rewritten(df, plan_for(df, "orders", [rule], ["o_orderkey"]), KEYRING)


@query
def digits_composite_key(spark, sf_dir):
    df = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("value"))
    rule = {"name": "value", "strategy": "digits", "params": {"length": 30}}
    return rewritten(df, plan_for(df, "conversations", [rule], ["conv_id", "turn"]), KEYRING)


@query
def number_full_range(spark, sf_dir):
    df = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("value"))
    rule = {"name": "value", "strategy": "number", "params": {"min": -(2**63), "max": 2**63 - 1}}
    return rewritten(df, plan_for(df, "orders", [rule], ["o_orderkey"]), KEYRING)


@query
def keyless_table(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem")
    columns = [
        {"name": "l_returnflag", "strategy": "hash", "params": {"length": 8}},
        {"name": "l_linestatus", "strategy": "vatId"},
    ]
    df = df.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    return rewritten(df, plan_for(df, "lineitem", columns), KEYRING)


@query
def output_length(spark, sf_dir):
    """Declared width of each fixed-width strategy beside what it really makes."""
    df = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    rules = {
        "hash": {}, "digits": {"length": 8}, "alphanumeric": {"length": 7}, "phone": {}, "date": {},
        "uuid": {}, "vatId": {}, "iban": {},
    }
    wide = df.select("c_custkey", *[F.col("c_name").alias(f"v_{name}") for name in rules])
    columns = [
        {"name": f"v_{name}", "strategy": name, **({"params": p} if p else {})} for name, p in rules.items()
    ]
    plan = plan_for(wide, "customer", columns, ["c_custkey"])
    made = rewritten(wide, plan, KEYRING)
    widths = F.array(*[
        F.struct(F.lit(rule.strategy).alias("strategy"), F.lit(rule.output_length()).alias("declared"),
                 F.char_length(rule.name).alias("made"))
        for rule in plan.rules
    ])
    return made.select(F.inline(widths)).groupBy("strategy", "declared").agg(
        F.min("made").alias("shortest"), F.max("made").alias("longest"), F.count("*").alias("n")
    )


# --- joins and checks ---------------------------------------------------------------------


def _named_orders(spark, sf_dir):
    """Orders carrying a copy of their customer's name."""
    names = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("o_name"))
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(names, "o_custkey")


@query
def link_preserved(spark, sf_dir):
    parent = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    child = _named_orders(spark, sf_dir)
    left = rewritten(child, plan_for(child, "orders", [{"name": "o_name", "strategy": "fullName"}]), KEYRING)
    right = rewritten(parent, plan_for(parent, "customer", [{"name": "c_name", "strategy": "fullName"}]), KEYRING)
    return checks.link_preserved(left, right, [("o_custkey", "c_custkey"), ("o_name", "c_name")])


@query
def link_preserved_pair(spark, sf_dir):
    """Agreement on the pseudonym alone, before and after a rule that breaks it."""
    parent = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    child = _named_orders(spark, sf_dir)
    rule = {"name": "c_name", "strategy": "phone"}
    right = rewritten(parent, plan_for(parent, "customer", [rule]), KEYRING)
    kept = rewritten(child, plan_for(child, "orders", [{**rule, "name": "o_name"}]), KEYRING)
    broken_rule = {**rule, "name": "o_name", "consistent": False}
    broken = rewritten(child, plan_for(child, "orders", [broken_rule], ["o_orderkey"]), KEYRING)
    on = [("o_custkey", "c_custkey"), ("o_name", "c_name")]
    made = [
        checks.link_preserved(frame, right, on).select(F.lit(label).alias("rule"), "child_rows", "linked_rows")
        for label, frame in (("consistent", kept), ("row", broken))
    ]
    return made[0].unionByName(made[1])


@query
def table_checksum(spark, sf_dir):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    return checks.table_checksum(load(spark, sf_dir, "orders"), columns)


@query
def unique_check(spark, sf_dir):
    return _unique_checks(spark, sf_dir)


@query
def unique_check_words(spark, sf_dir):
    """The same keys as large tables' keys are counted: in words of 64 integers."""
    return _unique_checks(spark, sf_dir, small=0)


def _unique_checks(spark, sf_dir, **options):
    inputs = {
        "lineitem": ["l_orderkey", "l_linenumber"], "conversations": ["conv_id", "turn"], "orders": ["o_orderkey"],
    }
    made = [
        checks.unique_check(load(spark, sf_dir, t), key, **options).select(F.lit(t).alias("table_name"), "*")
        for t, key in inputs.items()
    ]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query
def preflight(spark, sf_dir):
    """Checks before any write: each policy over the real tables, and the class it ends in."""
    tables = {
        t: load(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "conversations", "events", "embeddings")
    }
    keys = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"],
            "conversations": ["conv_id", "turn"], "events": ["event_id"], "embeddings": ["vec_id"]}
    overlays = {t: {"primaryKey": k, "columns": {n: {"nullable": False} for n in k}} for t, k in keys.items()}
    overlays["customer"]["columns"] |= {"c_name": {"length": 30}, "c_mktsegment": {"nullable": False}}
    source = Tables({"demo": tables}, {"demo": overlays})
    wide = {"strategy": "hash"}
    cases = {
        "key_with_duplicates": ("lineitem", {"name": "l_returnflag", **wide}),
        "composite_key": ("conversations", {"name": "role", "strategy": "digits", "params": {"length": 9}}),
        "plain": ("orders", {"name": "o_orderstatus", **wide}),
        "missing_column": ("orders", {"name": "absent", **wide}),
        "key_as_target": ("orders", {"name": "o_orderkey", "strategy": "number"}),
        "text_into_number": ("orders", {"name": "o_totalprice", "strategy": "city"}),
        "date_into_time": ("orders", {"name": "o_orderdate", "strategy": "date"}),
        "late_start": ("orders", {"name": "o_orderdate", "strategy": "date", "params": {"from": "2030-01-01"}}),
        "number_too_wide": ("customer", {"name": "c_nationkey", "strategy": "number", "params": {"max": 2**31}}),
        "no_room": ("customer", {"name": "c_name", **wide}),
        "no_room_for_mail": ("customer", {"name": "c_name", "strategy": "email"}),
        "null_into_required": ("customer", {"name": "c_mktsegment", "strategy": "null"}),
        "array_target": ("embeddings", {"name": "embedding", "strategy": "constant", "params": {"value": "x"}}),
        "array_to_null": ("embeddings", {"name": "embedding", "strategy": "null"}),
        "missing_table": ("absent", {"name": "x", **wide}),
    }
    rows = []
    for case, (table, column) in cases.items():
        policy = {"databases": [{"namePattern": "de.o", "tables": [{"name": table, "columns": [column]}]}]}
        report = Run(spark, policy, source, _options(spark, "preflight", dry_run=True)).execute()
        rows.append((case, report.failure_class or report.result, report.exit_code()))
    return spark.createDataFrame(rows, "policy string, outcome string, exit_code int")


@query
def value_violation(spark, sf_dir):
    df = load(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("short_text"), F.col("c_name").alias("tight_mail"),
        F.col("c_nationkey").cast("tinyint").alias("tiny"), F.lit(1).cast("decimal(5,2)").alias("money"),
        F.col("c_mktsegment").alias("fits"),
    )
    overlay = {"columns": {"short_text": {"length": 12}, "tight_mail": {"length": 40}, "fits": {"length": 64},
                           "tiny": {"unsigned": True}}}
    columns = [
        {"name": "short_text", "strategy": "mask"},
        {"name": "tight_mail", "strategy": "email", "params": {"domain": "mail.example.com"}},
        {"name": "tiny", "strategy": "number", "params": {"min": -20, "max": 300}},
        {"name": "money", "strategy": "number", "params": {"min": 0, "max": 2000}},
        {"name": "fits", "strategy": "hash"},
    ]
    plan = plan_for(df, "customer", columns, ["c_custkey"], where="c_custkey % 10 = 0", overlay=overlay)
    return violation_counts(df, plan, KEYRING)


@query
def unique_resolve(spark, sf_dir):
    """Codes of five digits: some collide."""
    df = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("code"), "c_mktsegment")
    columns = [
        {"name": "code", "strategy": "digits", "params": {"length": 5}},
        {"name": "c_mktsegment", "strategy": "hash", "params": {"length": 10}},
    ]
    plan = plan_for(df, "customer", columns, ["c_custkey"], unique=(("code",),))
    return transform_unique(df, plan, KEYRING, resolve_unique(df, plan, KEYRING))


# --- runs ---------------------------------------------------------------------------------

ORDERS_RULES = [
    {"name": "o_orderstatus", "strategy": "digits", "params": {"length": 6}},
    {"name": "o_orderpriority", "strategy": "mask", "params": {"keepPrefix": 1}},
]


def _policy(**extra):
    return {
        "databases": [{
            "name": "demo",
            "tables": [
                {"name": "customer", "ignore": {"where": "c_nationkey = 3"}, "columns": [
                    {"name": "c_name", "strategy": "fullName"},
                    {"name": "c_acctbal", "strategy": "number"},
                ]},
                {"name": "orders", "columns": ORDERS_RULES},
                {"name": "supplier", "action": "Truncate"},
                {"name": "absent", "optional": True, "columns": [{"name": "x", "strategy": "hash"}]},
            ],
        }],
        **extra,
    }


def _dataset(spark, sf_dir):
    names = {"customer": "c_custkey", "orders": "o_orderkey", "supplier": "s_suppkey"}
    not_null = {t: {"primaryKey": [k], "columns": {k: {"nullable": False}}} for t, k in names.items()}
    return Tables({"demo": {t: load(spark, sf_dir, t) for t in names}}, {"demo": not_null})


def _options(spark, label, **extra):
    return RunOptions(label, SEED, REFERENCE_DATE, scratch_path(spark, label), **extra)


@query
def dry_run(spark, sf_dir):
    """A dry run checks everything and writes nothing: the tables' checksums do not move."""
    source = _dataset(spark, sf_dir)
    columns = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    before = written(checks.table_checksum(source.table("demo", "customer"), columns), "checksum")
    report = Run(spark, _policy(), source, _options(spark, "dry-run", dry_run=True)).execute()
    after = checks.table_checksum(source.table("demo", "customer"), columns)
    same = before.select(F.col("checksum").alias("was")).crossJoin(after)
    return same.select(
        F.lit(report.result).alias("result"), F.lit(report.tablesTotal).alias("tables_total"),
        F.lit(report.rowsDone).cast("bigint").alias("rows_done"),
        (F.col("was") == F.col("checksum")).alias("unchanged"), F.col("rows").alias("n"),
    )


@query
def run_totals(spark, sf_dir):
    """A whole run: selected rows per table, and what the report says."""
    run = Run(spark, _policy(), _dataset(spark, sf_dir), _options(spark, "totals", chunks=2))
    report = run.execute()
    return totals_of_run(run.manifest, "totals").select(
        F.col("name").alias("table_name"), "rows_done",
        F.lit(report.tablesDone).alias("tables_done"), F.lit(report.rowsDone).cast("bigint").alias("report_rows_done"),
        F.lit(report.result).alias("result"),
    )


@query
def truncate_table(spark, sf_dir):
    """Row counts of the run's outputs beside those of its inputs."""
    source = _dataset(spark, sf_dir)
    run = Run(spark, _policy(), source, _options(spark, "truncate"))
    run.execute()
    counted = [
        frame.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), F.lit(table).alias("table_name"), "n")
        for table in ("customer", "supplier")
        for side, frame in (("before", source.table("demo", table)), ("after", run.result("demo", table)))
    ]
    made = counted[0]
    for frame in counted[1:]:
        made = made.unionByName(frame)
    return made


class _Lost(Exception):
    """Stands for a driver that is lost between two chunks."""


def _resumed(spark, label, df, columns, key, chunks):
    """What three drivers after each other wrote of a table."""
    manifest, identity = _three_drivers(spark, label, df, columns, key, chunks)
    return resume.committed(manifest, identity).select(*df.columns)


def _three_drivers(spark, label, df, columns, key, chunks, **options):
    """Three drivers after each other over one manifest: two are lost on the way, the last one ends the run."""
    plan = plan_for(df, "orders", columns, key)
    output = scratch_path(spark, label)
    identity = ProgressKey(label, "table", "demo", "orders", POLICY_HASH)
    for lives in (1, 1, 99):
        left = iter([True] * lives)

        def rewrite(part, left=left):
            if not next(left, False):
                raise _Lost
            return transform(part, plan, KEYRING, mark=True)

        manifest = Manifest(spark, f"{output}/_progress")
        try:
            resume.run_chunks(df, rewrite, lambda: chunks(df), manifest, identity, f"{output}/rows", tuple(key), **options)
        except _Lost:
            pass
    return Manifest(spark, f"{output}/_progress"), identity


def _some_orders(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query
def write_table(spark, sf_dir):
    """The rewritten orders written to a new place and read back."""
    df = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    path = scratch_path(spark, "written")
    dataset.write_table(rewritten(df, plan_for(df, "orders", ORDERS_RULES, ["o_orderkey"]), KEYRING), path)
    return spark.read.parquet(path)


@query
def null_array(spark, sf_dir):
    """NULL fits columns that no other strategy can write."""
    df = load(spark, sf_dir, "embeddings")
    out = rewritten(df, plan_for(df, "embeddings", [{"name": "embedding", "strategy": "null"}], ["vec_id"]), KEYRING)
    return out.select("vec_id", "label", F.size("embedding").alias("n_values"))


@query
def chunk_resume(spark, sf_dir):
    key = ["o_orderkey"]
    return _resumed(spark, "by-key", _some_orders(spark, sf_dir), ORDERS_RULES, key, lambda df: resume.key_chunks(df, tuple(key), 4))


@query
def checksum_chunks(spark, sf_dir):
    """Checksums added up from chunks' commits, of a source and of what three drivers wrote, beside those of one pass."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    df = written(load(spark, sf_dir, "orders").select(*columns).repartition(6, "o_orderkey"), "split")
    rules = [{"name": name, "strategy": "mask", "params": {"keepPrefix": 1}} for name in ("o_orderpriority", "o_orderstatus")]
    manifest, identity = _three_drivers(
        spark, "summed", df, rules, ["o_orderkey"], lambda df: resume.file_chunks(df, 3), checksums=True)
    proof = ProgressKey("summed/before", "proof", "demo", "orders", POLICY_HASH)
    resume.prove_chunks(df, lambda: resume.file_chunks(df, 4), manifest, proof)
    made = []
    for side, key, rows in (("source", proof, df), ("result", identity, resume.committed(manifest, identity))):
        merged = resume.merged_checksum(manifest, key)
        made.append(checks.table_checksum(rows, columns).select(
            F.lit(side).alias("side"), F.lit(merged.rows).cast("bigint").alias("rows"),
            F.lit(merged.checksum).cast("decimal(38,0)").alias("checksum"),
            ((F.col("rows") == merged.rows) & (F.col("checksum") == F.lit(merged.checksum))).alias("equals_one_pass")))
    return made[0].unionByName(made[1])


@query
def chunk_resume_files(spark, sf_dir):
    """The same run over groups of input files; the source is split into several files first."""
    df = written(_some_orders(spark, sf_dir).repartition(6, "o_orderkey"), "split")
    return _resumed(spark, "by-files", df, ORDERS_RULES, ["o_orderkey"], lambda df: resume.file_chunks(df, 3))


@query
def chunk_resume_text_key(spark, sf_dir):
    """A table whose key is text: chunks are parts by the key's hash."""
    df = load(spark, sf_dir, "customer").select("c_name", "c_custkey", "c_mktsegment")
    rules = [{"name": "c_mktsegment", "strategy": "digits", "params": {"length": 9}}]
    return _resumed(spark, "by-name", df, rules, ["c_name"], lambda df: resume.key_chunks(df, ("c_name",), 4))


@query
def chunk_resume_composite(spark, sf_dir):
    key = ["conv_id", "turn"]
    df = load(spark, sf_dir, "conversations").select(*key, "role", "text")
    rules = [{"name": "text", "strategy": "hash"}, {"name": "role", "strategy": "digits", "params": {"length": 4}}]
    return _resumed(spark, "by-pair", df, rules, key, lambda df: resume.key_chunks(df, tuple(key), 3))


@query
def chunk_resume_partitioned(spark, sf_dir):
    """A run over a partitioned table by file groups: partition columns come back with their rows."""
    root = scratch_path(spark, "partitioned")
    year = F.year("o_orderdate").alias("year")
    load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", year).repartition("year").write.partitionBy(
        "year").parquet(f"{root}/demo/orders")
    overlay = {"primaryKey": ["o_orderkey"], "columns": {"o_orderkey": {"nullable": False}}}
    source = dataset.Folder(spark, root, overlays={"demo": {"orders": overlay}})
    policy = {"databases": [{"name": "demo", "tables": [{"name": "orders", "columns": ORDERS_RULES}]}]}
    run = Run(spark, policy, source, _options(spark, "partitioned-run", chunks=3, chunk_by="files"))
    run.execute()
    # Digests depend on the policy's own hash, which SQL does not rebuild: the columns beside them are compared.
    return run.result("demo", "orders").select(
        "o_orderkey", "year", "o_orderpriority", F.length("o_orderstatus").alias("width"))


@query
def keyless_run(spark, sf_dir):
    """A run over a table without a key, in file groups: every row is there, repeated ones too."""
    root = scratch_path(spark, "keyless")
    load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity").repartition(
        5, "l_orderkey").write.parquet(f"{root}/demo/lineitem")
    policy = {"databases": [{"name": "demo", "tables": [{"name": "lineitem", "columns": [
        {"name": "l_returnflag", "strategy": "mask"}]}]}]}
    run = Run(spark, policy, dataset.Folder(spark, root), _options(spark, "keyless-run", chunks=2, allow_keyless=True))
    run.execute()
    return run.result("demo", "lineitem")


@query
def folder_of_orc(spark, sf_dir):
    """A run over ORC files in file groups."""
    root = scratch_path(spark, "orc")
    load(spark, sf_dir, "supplier").repartition(3, "s_suppkey").write.orc(f"{root}/demo/supplier")
    overlay = {"primaryKey": ["s_suppkey"], "columns": {"s_suppkey": {"nullable": False}}}
    policy = {"databases": [{"name": "demo", "tables": [{"name": "supplier", "columns": [
        {"name": "s_name", "strategy": "mask", "params": {"keepPrefix": 3}}]}]}]}
    source = dataset.Folder(spark, root, "orc", {"demo": {"supplier": overlay}})
    run = Run(spark, policy, source, _options(spark, "orc-run", chunks=2, chunk_by="files"))
    run.execute()
    return run.result("demo", "supplier")


@query
def run_keeps_layout(spark, sf_dir):
    """A run over partitioned ORC by pages gives partitioned ORC: rows, their folders and their files' format."""
    root = scratch_path(spark, "layout")
    year = F.year("o_orderdate").alias("year")
    load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", year).repartition(4, "year").write.partitionBy(
        "year").orc(f"{root}/demo/orders")
    overlay = {"primaryKey": ["o_orderkey"], "columns": {"o_orderkey": {"nullable": False}}}
    source = dataset.Folder(spark, root, "orc", {"demo": {"orders": overlay}})
    policy = {"databases": [{"name": "demo", "tables": [{"name": "orders", "columns": ORDERS_RULES[1:]}]}]}
    run = Run(spark, policy, source, _options(spark, "layout-run", page_size=100, pages=10))
    run.execute()
    place = F.col("_metadata.file_path")
    out = run.result("demo", "orders")
    return out.select("o_orderkey", "year", "o_orderpriority", F.regexp_extract(place, "/year=([0-9]+)/", 1).cast("int").alias("folder"),
                      F.regexp_extract(place, "[.]([a-z]+)$", 1).alias("format"))


@query
def chunk_resume_packed(spark, sf_dir):
    """A resumed run over packs of files, of a table whose files are not clustered by its key."""
    df = written(_some_orders(spark, sf_dir).repartition(12), "spread")
    plan = scratch_path(spark, "packs")
    return _resumed(spark, "by-packs", df, ORDERS_RULES, ["o_orderkey"], lambda df: resume.packed_chunks(df, plan, count=4))


@query
def progress_identity(spark, sf_dir):
    """Per chunk of a finished run: its rule, and whether exactly one commit belongs to it."""
    run = Run(spark, _policy(), _dataset(spark, sf_dir), _options(spark, "identity", chunks=3))
    run.execute()
    rows = run.manifest.rows().where("kind = 'table' and name <> 'supplier'")
    return rows.groupBy("name", "chunk").agg(
        F.max("rule").alias("rule"), F.count_if("done").alias("commits"), F.count_if(~F.col("done")).alias("plans"),
        F.countDistinct("policy_hash").alias("hashes"))


@query
def skip_done_chunks(spark, sf_dir):
    """Pages of orders that no committed page covers."""
    pages = load(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 500).cast("bigint").alias("page"), "o_orderkey")
    planned = pages.groupBy("page").agg(F.count("*").alias("n"))
    finished = pages.where("o_orderkey % 1500 = 1").select("page")
    return resume.pending_chunks(planned, finished, ["page"])


@query
def step_once(spark, sf_dir):
    """A SQL step over the orders runs the first time and is skipped the second."""
    load(spark, sf_dir, "orders").createOrReplaceTempView("step_orders")
    output = scratch_path(spark, "step")
    body = (
        f"INSERT OVERWRITE DIRECTORY '{output}/result' USING parquet "
        "SELECT o_orderpriority, count(*) AS n FROM step_orders WHERE o_orderstatus <> ';' GROUP BY o_orderpriority"
    )
    manifest = Manifest(spark, f"{output}/_progress")
    key = ProgressKey("steps", "step", "demo", "pre:0:summary", POLICY_HASH)
    ran = [run_step(spark, body, manifest, key) for _ in range(2)]
    result = spark.read.parquet(f"{output}/result")
    return result.select("o_orderpriority", "n", F.lit(ran[0]).alias("first_ran"), F.lit(ran[1]).alias("second_ran"))


@query
def continue_on_error(spark, sf_dir):
    """A step that is refused, since it belongs to another policy, is passed over; the next one runs."""
    load(spark, sf_dir, "orders").createOrReplaceTempView("step_orders")
    output = scratch_path(spark, "continued")
    manifest = Manifest(spark, f"{output}/_progress")
    run_step(spark, "SELECT count(*) FROM step_orders", manifest, ProgressKey("steps", "step", "demo", "pre:0:first", POLICY_HASH))
    bodies = {"first": "SELECT count(*) FROM step_orders", "second": (
        f"INSERT OVERWRITE DIRECTORY '{output}/result' USING parquet "
        "SELECT o_orderstatus, count(*) AS n FROM step_orders GROUP BY o_orderstatus")}
    done = run_steps(
        spark, "pre", [{"name": "first"}, {"name": "second"}], {"first": {"continueOnError": True}, "second": {}}, bodies,
        manifest, ("steps", "demo", "sha256:" + "6b" * 32),
    )
    return spark.read.parquet(f"{output}/result").withColumn("steps_done", F.lit(done))


@query
def step_multi(spark, sf_dir):
    """A body of several statements runs whole; a `;` inside a string does not split it."""
    load(spark, sf_dir, "orders").createOrReplaceTempView("step_orders")
    output = scratch_path(spark, "script")
    body = f"""
    BEGIN
      DECLARE low STRING DEFAULT '5-LOW';
      INSERT OVERWRITE DIRECTORY '{output}/a' USING parquet
        SELECT o_orderstatus AS label, count(*) AS n FROM step_orders WHERE o_orderpriority = low GROUP BY o_orderstatus;
      INSERT OVERWRITE DIRECTORY '{output}/b' USING parquet
        SELECT concat('all;', o_orderstatus) AS label, count(*) AS n FROM step_orders GROUP BY o_orderstatus;
    END
    """
    manifest = Manifest(spark, f"{output}/_progress")
    run_step(spark, body, manifest, ProgressKey("steps", "step", "demo", "post:0:script", POLICY_HASH))
    return spark.read.parquet(f"{output}/a").unionByName(spark.read.parquet(f"{output}/b"))


@query
def apply_policy_stream_events(spark, sf_dir):
    schema = load(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = stream.select("event_id", "event_type", F.col("props").alias("value"))
    columns = [
        {"name": "event_type", "strategy": "hash", "params": {"length": 16}},
        {"name": "value", "strategy": "digits", "params": {"length": 9}},
    ]
    out = apply_policy_stream(stream, plan_for(stream, "events", columns, ["event_id"]), KEYRING)
    output = scratch_path(spark, "stream")
    start_to_files(out, f"{output}/rows", f"{output}/state").start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{output}/rows")


# --- ledgers ------------------------------------------------------------------------------


def _plain(df: DataFrame, *moments: str) -> DataFrame:
    return df.withColumns({m: F.col(m).cast("timestamp_ntz") for m in moments})


@query
def stream_commits(spark, sf_dir):
    """Micro-batches committed through a run's manifest; the stream starts a second time and finds nothing to do."""
    schema = load(spark, sf_dir, "events").schema
    output = scratch_path(spark, "commits")
    manifest, key = Manifest(spark, f"{output}/_progress"), ProgressKey("stream", "table", "demo", "events", POLICY_HASH)
    columns = [{"name": "event_type", "strategy": "hash", "params": {"length": 16}}]
    for _ in range(2):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("event_id", "event_type")
        start_checked(stream, plan_for(stream, "events", columns, ["event_id"]), KEYRING, manifest, key, f"{output}/rows",
                      f"{output}/state").start().awaitTermination()
    return resume.committed(manifest, key)


@query
def state_counts(spark, sf_dir):
    return ledger.state_counts(demo.backups(spark, sf_dir), ["cluster"])


@query
def candidate_filter(spark, sf_dir):
    found = ledger.candidate_filter(demo.backups(spark, sf_dir), storages=["s0", "s3"]).where(ledger.selectable())
    return found.select("cluster", "name", "state", ledger.storage_name().alias("storage"))


@query
def latest_succeeded(spark, sf_dir):
    found = ledger.latest_succeeded(demo.backups(spark, sf_dir), ["cluster"])
    return _plain(found, "selected_created_at", "selected_completed_at")


@query
def selection_reason(spark, sf_dir):
    return ledger.selection_reason(demo.backups(spark, sf_dir), ["cluster"])


@query
def no_candidate_reason(spark, sf_dir):
    """Per minute of the ledger, so that many groups have nothing to select."""
    table = demo.backups(spark, sf_dir).withColumn("hour", F.date_format("created_at", "yyyy-MM-dd HH"))
    current = table.groupBy("hour").agg(F.min("name").alias("first_name")).select(
        "hour",
        F.when(F.substring("hour", -1, 1) == "1", F.concat(F.lit("gone-"), "first_name"))
        .when(F.substring("hour", -1, 1) == "2", F.col("first_name")).alias("current"),
    )
    return ledger.no_candidate_reason(table, current, ["hour"])


@query
def freshness(spark, sf_dir):
    found = ledger.latest_succeeded(demo.backups(spark, sf_dir), ["cluster"])
    return ledger.freshness(found, demo.now()).select("cluster", "selected", "fresh")


@query
def retention_prune(spark, sf_dir):
    doomed = ledger.retention_prune(demo.backups(spark, sf_dir), demo.owners(spark, sf_dir), ["cluster"], demo.now())
    return doomed.select("cluster", "name", "state")


@query
def settled_owner_filter(spark, sf_dir):
    return ledger.settled_owner_filter(demo.backups(spark, sf_dir), demo.owners(spark, sf_dir)).select("name", "run_uid")


@query
def history_prune(spark, sf_dir):
    doomed = ledger.history_prune(demo.runs(spark, sf_dir), ["schedule"], 3, 1)
    return doomed.select("schedule", "name", "phase")


@query
def run_status_rollup(spark, sf_dir):
    return _plain(ledger.run_status_rollup(demo.runs(spark, sf_dir), ["schedule"]), "last_success")


@query
def active_runs(spark, sf_dir):
    return ledger.active_runs(demo.runs(spark, sf_dir), ["schedule"])


@query
def phase_distribution(spark, sf_dir):
    return ledger.phase_distribution(demo.runs(spark, sf_dir), ["schedule"])


@query
def stage_durations(spark, sf_dir):
    made = ledger.stage_durations(demo.runs(spark, sf_dir), ["name"])
    return made.select("name", "stage", F.col("seconds").cast("bigint").alias("seconds"))


@query
def condition_transitions(spark, sf_dir):
    table = demo.runs(spark, sf_dir).select(
        "name", F.lit("Complete").alias("type"), F.when(F.col("phase") == "Completed", "True").otherwise("False").alias("status"),
        F.col("completed_at").alias("changed_at"),
    )
    return ledger.condition_transitions(table, ["name"])


@query
def read_pointer_doc(spark, sf_dir):
    made = documents.write_pointers(documents.read_pointers(demo.pointers(spark, sf_dir)))
    return made.select("event_id", "valid", F.col("document.schemaVersion").alias("version"), "json")


@query
def pointer_max_age(spark, sf_dir):
    found = documents.read_pointers(demo.pointers(spark, sf_dir)).where("valid").select(
        "event_id", F.col("document.schemaVersion").alias("schema_version"),
        documents.moment(F.col("document.publishedAt")).alias("published_at"),
    )
    return ledger.pointer_max_age(found, demo.now(), 240).select("event_id", "accepted", "warning")


@query
def read_run_logs(spark, sf_dir):
    parsed = documents.parse_logs(ledger.last_lines(demo.logs(spark, sf_dir), ["run"]))
    return parsed.select("run", "line_no", "msg", "step", "tablesDone", "rowsDone")


@query
def latest_progress(spark, sf_dir):
    return ledger.latest_progress(documents.parse_logs(ledger.last_lines(demo.logs(spark, sf_dir), ["run"])), ["run"])


@query
def step_outcomes(spark, sf_dir):
    return ledger.step_outcomes(documents.parse_logs(ledger.last_lines(demo.logs(spark, sf_dir), ["run"])), ["run"])


# --- fixture formulas, one row per customer or order instead of a fixed count ----------------


def _numbers(spark, sf_dir, table, key):
    return load(spark, sf_dir, table).select((F.col(key) + 1).alias("n"))


def _users_total(spark, sf_dir):
    return load(spark, sf_dir, "customer").count()


def _fixture_users(spark, sf_dir):
    return fixtures.users(_numbers(spark, sf_dir, "customer", "c_custkey"))


@query
def fixture_seed(spark, sf_dir):
    return _fixture_users(spark, sf_dir)


@query
def fixture_organisations(spark, sf_dir):
    return fixtures.organisations(_numbers(spark, sf_dir, "customer", "c_custkey"), _users_total(spark, sf_dir))


@query
def fixture_join(spark, sf_dir):
    n = _numbers(spark, sf_dir, "orders", "o_orderkey")
    return fixtures.commissions(n, _fixture_users(spark, sf_dir), _users_total(spark, sf_dir))


@query
def fixture_addresses(spark, sf_dir):
    n = _numbers(spark, sf_dir, "orders", "o_orderkey")
    return fixtures.addresses(n, _fixture_users(spark, sf_dir), _users_total(spark, sf_dir))


@query
def fixture_links(spark, sf_dir):
    """The demo set's own link check: commission, user and identity agree on names and mail."""
    n = _numbers(spark, sf_dir, "orders", "o_orderkey")
    users = _fixture_users(spark, sf_dir)
    commission = fixtures.commissions(n, users, _users_total(spark, sf_dir))
    identity = fixtures.commission_identities(commission).select(
        F.col("commission_id").alias("id"), F.col("email").alias("identity_email"), "ip"
    )
    child = commission.join(identity, "id")
    return checks.link_preserved(child, users, [
        ("user_id", "id"), ("email", "email"), ("given_name", "given_name"), ("family_name", "family_name"),
        ("identity_email", "email"),
    ])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_table(spark, sf_dir)


assert all(compile_rule({"strategy": n, "params": p}) for n, (_, _, _, p) in STRATEGY_INPUTS.items())

import datetime as dt

import pytest
from pyspark.sql import functions as F

import scalar
from veilwright import Keyring, TableTransform, compile_rule, resolve_unique, table_info, transform, transform_unique
from veilwright.errors import UniqueError
from veilwright.operators.unique import RETRY

KEYRING = Keyring.derive(b"u" * 32, "sha256:" + "1" * 64, dt.date(2026, 1, 2))


def plan_for(df, columns, key, unique, where=None):
    info = table_info(df.schema)
    return TableTransform(
        "demo", "people", tuple(compile_rule(c) for c in columns), tuple(info.column(c["name"]) for c in columns),
        tuple(info.column(k) for k in key), where, unique,
    )


def one_by_one(rows, length, kept=(), originals=True):
    """Rewrite rows in key order, trying retries until the value is free in the stored table."""
    stored = dict(rows)
    result = {}
    for pk in sorted(stored):
        if pk in kept:
            result[pk] = (stored[pk], 0)
            continue
        for retry in range(8):
            value = scalar.digits(scalar.digest(KEYRING, "digits", row=("demo", "people", f"[{pk}]", "code"), retry=retry), length)
            if originals:
                others = {v for k, v in stored.items() if k != pk}
            else:
                others = {v for k, (v, _) in result.items()} | {stored[k] for k in kept}
            if value not in others:
                stored[pk] = value
                result[pk] = (value, retry)
                break
        else:
            raise UniqueError("exhausted")
    return result


@pytest.mark.parametrize("count,length,originals", [(40, 2, False), (70, 3, True), (45, 2, True), (300, 4, False), (300, 4, True)])
def test_same_result_as_one_row_at_a_time(spark, count, length, originals):
    rows = [(i, str(10**length - 1 - i).zfill(length) if originals else f"original-{i}") for i in range(count)]
    df = spark.createDataFrame(rows, "id long, code string")
    where = "id % 11 = 5"
    kept = {i for i, _ in rows if i % 11 == 5}
    plan = plan_for(df, [{"name": "code", "strategy": "digits", "params": {"length": length}}], ["id"], (("code",),), where)
    try:
        want = one_by_one(rows, length, kept, originals)
    except UniqueError:
        with pytest.raises(UniqueError):
            resolve_unique(df.repartition(5), plan, KEYRING, originals)
        return
    retries = resolve_unique(df.repartition(5), plan, KEYRING, originals)
    got = {r["id"]: r["code"] for r in transform_unique(df, plan, KEYRING, retries).collect()}
    assert got == {pk: value for pk, (value, _) in want.items()}
    assert {r["id"]: r[RETRY] for r in retries.collect()} == {pk: r for pk, (_, r) in want.items() if r}


def test_nulls_never_collide_and_no_collision_needs_no_retry(spark):
    df = spark.range(40).select("id", F.when(F.col("id") < 20, F.concat(F.lit("x"), "id")).alias("code"))
    plan = plan_for(df, [{"name": "code", "strategy": "hash"}], ["id"], (("code",),))
    assert resolve_unique(df, plan, KEYRING) is None
    other = plan_for(df, [{"name": "code", "strategy": "hash"}], ["id"], (("id",),))
    assert resolve_unique(df, other, KEYRING) is None


def test_hot_value_and_composite_keys(spark):
    """A third of the rows generate one value at first; composite key, composite index, whole-row retries."""
    df = spark.range(300).select(
        (F.col("id") % 7).alias("a"), F.col("id").alias("b"), F.lit("g").alias("grp"),
        F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("v"), "id")).alias("code"),
        F.lit("n").alias("note"),
    )
    columns = [
        {"name": "code", "strategy": "digits", "params": {"length": 3}},
        {"name": "note", "strategy": "hash", "params": {"length": 6}},
    ]
    plan = plan_for(df, columns, ["a", "b"], (("grp", "code"),))
    retries = resolve_unique(df, plan, KEYRING, against_originals=False)
    out = transform_unique(df, plan, KEYRING, retries).cache()
    assert out.count() == 300 and out.select("grp", "code").distinct().count() == 300
    moved = {(r["a"], r["b"]): r[RETRY] for r in retries.collect()}
    notes = {(r["a"], r["b"]): r["note"] for r in out.collect()}
    base = notes[next(k for k in notes if k not in moved)]
    assert moved and all((notes[k] != base) == (k in moved) for k in notes)


def test_two_indexes_with_nulls_and_kept_rows(spark):
    """Rows without any value never move, however many they are; a value that a kept row holds is never had."""
    df = spark.range(120).select(
        "id", F.when(F.col("id") % 3 > 0, F.format_string("%02d", F.col("id") % 100)).alias("code"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("a"), "id")).alias("other"),
    )
    columns = [
        {"name": "code", "strategy": "digits", "params": {"length": 3}, "consistent": False},
        {"name": "other", "strategy": "digits", "params": {"length": 3}, "consistent": False},
    ]
    plan = plan_for(df, columns, ["id"], (("code",), ("other",)), "id % 10 = 7")
    retries = resolve_unique(df.repartition(3), plan, KEYRING, against_originals=False)
    out = transform_unique(df, plan, KEYRING, retries).collect()
    moved = {r["id"]: r[RETRY] for r in retries.collect()}
    assert len(out) == 120 and moved and all(0 < n < 8 for n in moved.values())
    # Kept rows hold two digits or a letter's code, so all others have three digits, each once.
    for name in ("code", "other"):
        values = [r[name] for r in out if r[name] is not None and r["id"] % 10 != 7]
        assert len(values) == len(set(values)) and all(len(v) == 3 for v in values)
    assert all((r["code"] is None) == (r["id"] % 3 == 0) for r in out)
    assert not [i for i in moved if i % 12 == 0 or i % 10 == 7]


def test_many_attempts_come_from_one_digest(spark):
    """`attempts` gives the rows that one transform per attempt gives."""
    df = spark.range(20).select("id", F.concat(F.lit("v"), "id").alias("code"), F.lit("n").alias("note"))
    columns = [{"name": "code", "strategy": "digits", "params": {"length": 9}}, {"name": "note", "strategy": "hash", "params": {"length": 8}}]
    plan = plan_for(df, columns, ["id"], (("code",),), "id % 5 = 1")
    at_once = transform(df, plan, KEYRING, retry=RETRY, attempts=range(2, 6))
    apart = [transform(df.withColumn(RETRY, F.lit(n)), plan, KEYRING, retry=RETRY).withColumn(RETRY, F.lit(n)) for n in range(2, 6)]
    want = sorted(tuple(r) for one in apart for r in one.collect())
    assert sorted(tuple(r) for r in at_once.collect()) == want and len(want) == 80


def test_exhaustion_of_a_shared_consistent_value(spark):
    df = spark.range(30).select("id", F.lit(None).cast("string").alias("code"))
    plan = plan_for(df, [{"name": "code", "strategy": "hash", "onNull": "Generate"}], ["id"], (("code",),))
    with pytest.raises(UniqueError):
        resolve_unique(df, plan, KEYRING)

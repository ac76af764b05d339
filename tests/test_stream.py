import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilwright import Keyring, TableTransform, compile_rule, table_info, transform
from veilwright.errors import PolicyError
from veilwright.plans.progress import Manifest, ProgressKey
from veilwright.plans.resume import committed
from veilwright.streaming.apply_stream import apply_policy_stream, start_checked, start_to_files

KEYRING = Keyring.derive(b"u" * 32, "sha256:" + "1" * 64, dt.date(2026, 1, 2))


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, output, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batch = spark.range(100).select("id", F.concat(F.lit("Élan "), F.col("id") % 9).alias("v"))
    schema = batch.schema
    rules = (compile_rule({"name": "v", "strategy": "email", "params": {"domain": "e.example"}}),)
    info = table_info(schema)
    plan = TableTransform("demo", "t", rules, (info.column("v"),), (info.column("id"),))
    for part in (batch.where("id < 40"), batch.where("id >= 40")):
        part.write.mode("append").parquet(source)
        stream = apply_policy_stream(spark.readStream.schema(schema).parquet(source), plan, KEYRING)
        start_to_files(stream, output, state).start().awaitTermination()
    got = spark.read.parquet(output)
    assert sorted(got.collect()) == sorted(transform(batch, plan, KEYRING).collect()) and got.count() == 100
    unique = TableTransform("demo", "t", rules, (info.column("v"),), (info.column("id"),), unique=(("v",),))
    with pytest.raises(PolicyError):
        apply_policy_stream(spark.readStream.schema(schema).parquet(source), unique, KEYRING)
    with pytest.raises(PolicyError):
        apply_policy_stream(batch, plan, KEYRING)


def test_checked_batches_are_committed_once(spark, tmp_path):
    source, output, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batch = spark.range(100).selectExpr("id", "'v' || id AS v")
    info = table_info(batch.schema, {"columns": {"v": {"length": 12}}})
    plan = TableTransform("demo", "t", (compile_rule({"name": "v", "strategy": "hash", "params": {"length": 12}}),), (info.column("v"),), (info.column("id"),))
    manifest, key = Manifest(spark, str(tmp_path / "p")), ProgressKey("s", "table", "demo", "t", "sha256:" + "0" * 64)

    def run(plan, place=state):
        stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(source)
        start_checked(stream, plan, KEYRING, manifest, key, output, place).start().awaitTermination()

    batch.where("id < 40").coalesce(1).write.mode("append").parquet(source)
    run(plan)
    batch.where("id >= 40").coalesce(1).write.mode("append").parquet(source)
    run(plan)
    run(plan)
    got = committed(Manifest(spark, str(tmp_path / "p")), key)
    assert sorted(got.collect()) == sorted(transform(batch, plan, KEYRING).collect())
    # A stream that has lost its state repeats its batches; they are committed already.
    run(plan, str(tmp_path / "lost"))
    assert committed(manifest, key).count() == 100
    # A value that does not fit stops the query before its batch counts.
    narrow = table_info(batch.schema, {"columns": {"v": {"length": 5}}})
    bad = TableTransform("demo", "t", plan.rules, (narrow.column("v"),), (narrow.column("id"),))
    batch.selectExpr("id + 1000 AS id", "v").coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="does not fit"):
        run(bad)
    assert committed(Manifest(spark, str(tmp_path / "p")), key).count() == 100

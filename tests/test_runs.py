import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwright import Folder, PreflightOptions, Run, RunOptions, TableTransform, Tables, compile_rule, table_info
from veilwright import Keyring, transform
from veilwright.errors import PolicyError, SchemaError, UncertainStep, UniqueError, classify
from veilwright.operators import apply, checks
from veilwright.plans.policy import decode
from veilwright.plans.preflight import preflight
from veilwright.plans.progress import Manifest, ProgressKey
from veilwright.plans.report import Report
from veilwright.plans.resume import Chunk, committed, file_chunks, key_chunks, packed_chunks, run_chunks
from veilwright.plans.schema import ColumnInfo, unfit, violation
from veilwright.plans.steps import execute, resolve_step, run_step
from veilwright.sources.dataset import match_databases
from veilwright.sources.files import inside, read_bounded, read_seed

SEED = b"s" * 32
DAY = dt.date(2026, 1, 2)
KEY = {"primaryKey": ["id"], "columns": {"id": {"nullable": False}}}


def people(spark):
    return spark.createDataFrame([(1, "first"), (2, "second"), (3, None)], "id long, payload string")


def policy(columns=None, **table):
    columns = [{"name": "payload", "strategy": "hash"}] if columns is None else columns
    return {"databases": [{"name": "demo", "tables": [{"name": "people", "columns": columns, **table}]}]}


def check(spark, spec, overlay=KEY, df=None, **options):
    dataset = Tables({"demo": {"people": people(spark) if df is None else df}}, {"demo": {"people": overlay}})
    return preflight(decode(spec)[0], dataset, PreflightOptions(DAY, **options))


@pytest.mark.parametrize("spec,overlay,error", [
    (policy([{"name": "absent", "strategy": "hash"}]), KEY, SchemaError),
    (policy([{"name": "id", "strategy": "number"}]), KEY, SchemaError),
    (policy([{"name": "id", "strategy": "hash"}]), KEY, SchemaError),
    (policy(), {}, SchemaError),
    (policy(), {"primaryKey": ["payload"]}, SchemaError),
    (policy(primaryKey=["payload"]), KEY, SchemaError),
    (policy(primaryKey=["nope"]), KEY, SchemaError),
    (policy(), {**KEY, "columns": {**KEY["columns"], "payload": {"generated": True}}}, SchemaError),
    (policy(), {**KEY, "columns": {"payload": {"length": 63}}}, SchemaError),
    (policy([{"name": "payload", "strategy": "email"}]), {**KEY, "columns": {"payload": {"length": 31}}}, SchemaError),
    (policy([{"name": "payload", "strategy": "null"}]), {**KEY, "columns": {"payload": {"nullable": False}}}, SchemaError),
    (policy([{"name": "payload", "strategy": "date", "params": {"from": "2026-01-03"}}]), KEY, PolicyError),
    (policy([{"name": "payload", "strategy": "constant", "params": {"value": "abc"}}]),
     {**KEY, "columns": {"payload": {"length": 2}}}, SchemaError),
    (policy([{"name": "payload", "strategy": "hash"}, {"name": "PAYLOAD", "strategy": "mask"}]), KEY, SchemaError),
    (policy(ignore={"where": "nope = 1"}), KEY, SchemaError),
    ({"databases": [{"name": "other"}]}, KEY, SchemaError),
    ({"databases": [{"name": "demo"}, {"namePattern": "de.*"}]}, KEY, PolicyError),
    ({"databases": [{"name": "demo", "tables": [{"name": "absent", "columns": [{"name": "x", "strategy": "hash"}]}]}]},
     KEY, SchemaError),
])
def test_preflight_refuses(spark, spec, overlay, error):
    with pytest.raises(error):
        check(spark, spec, overlay)


def test_preflight_accepts(spark):
    plan = check(spark, policy([{"name": "PayLoad", "strategy": "hash"}]))
    assert plan.databases[0].tables[0].transform.columns[0].name == "payload" and plan.tables_total == 1
    check(spark, policy(primaryKey=["id"]), {"unique": [["id"]]})
    check(spark, policy(), {}, allow_keyless=True)
    with pytest.raises(SchemaError):
        check(spark, policy([{"name": "payload", "strategy": "text"}]), {}, allow_keyless=True)
    check(spark, {"databases": [{"name": "demo", "optional": True, "tables": [
        {"name": "gone", "optional": True, "action": "Truncate"}]}, {"name": "missing", "optional": True}]})
    doubled = people(spark).unionAll(people(spark))
    with pytest.raises(SchemaError):
        check(spark, policy(), df=doubled)
    check(spark, policy(), df=doubled, verify_keys=False)
    with pytest.raises(SchemaError):
        check(spark, policy(), df=people(spark).withColumn("id", F.nullif("id", F.lit(2))))


def test_all_findings_come_at_once(spark):
    columns = [{"name": "absent", "strategy": "hash"}, {"name": "payload", "strategy": "email"}, {"name": "id", "strategy": "city"}]
    spec = policy(columns, ignore={"where": "nope = 1"})
    spec["databases"][0]["tables"].append({"name": "lost", "columns": [{"name": "x", "strategy": "hash"}]})
    with pytest.raises(SchemaError) as failure:
        check(spark, spec, {**KEY, "columns": {**KEY["columns"], "payload": {"length": 31}}})
    for place in ("demo.people: ignore", "demo.people.absent", "demo.people.payload", "demo.people.id", "demo.lost"):
        assert place in failure.value.message


def test_database_patterns_cover_whole_names():
    names = ["app_1", "app_22", "xapp_1", "app_1\n"]
    matched = match_databases([{"namePattern": "app_[0-9]+"}], names)
    assert [name for _, name in matched] == ["app_1", "app_22"]
    assert match_databases([{"namePattern": "z", "optional": True}], names) == []


@pytest.mark.parametrize("kind,extra,text,good", [
    (T.ByteType(), {}, "128", False), (T.ByteType(), {}, "-128", True), (T.ByteType(), {"unsigned": True}, "255", True),
    (T.IntegerType(), {"unsigned": True}, "-1", False), (T.IntegerType(), {"bits": 24}, "8388608", False),
    (T.LongType(), {}, "9223372036854775807", True), (T.LongType(), {}, "9223372036854775808", False),
    (T.LongType(), {}, "abc", False), (T.LongType(), {}, "1.0", False), (T.LongType(), {"unsigned": True}, "18446744073709551615", True),
    (T.DecimalType(5, 2), {}, "1.234", False), (T.DecimalType(5, 2), {}, "0000999.99", True),
    (T.DecimalType(5, 2), {}, "1000", False), (T.DecimalType(5, 2), {"unsigned": True}, "-1", False),
    (T.DecimalType(5, 0), {}, "1.0", False), (T.DecimalType(5, 2), {}, ".5", False),
    (T.DoubleType(), {}, "1e3", True), (T.DoubleType(), {}, "x", False), (T.DoubleType(), {"unsigned": True}, "-0.5", False),
    (T.FloatType(), {}, "1e39", False),
    (T.DateType(), {}, "not a date", False), (T.DateType(), {}, "2024-02-29", True), (T.DateType(), {}, "2023-02-29", False),
    (T.DateType(), {}, "2024-01-01 00:00:00", False), (T.TimestampNTZType(), {}, "2024-01-01 10:11:12", True),
    (T.TimestampNTZType(), {}, "2024-01-01", True), (T.TimestampNTZType(), {}, "2024-01-01 25:00:00", False),
    (T.StringType(), {"length": 2}, "abc", False), (T.StringType(), {"length": 2}, "éé", True),
    (T.BinaryType(), {"length": 2}, "éé", False),
])
def test_values_that_fit_or_not(spark, kind, extra, text, good):
    info = ColumnInfo("v", kind, **extra)
    assert unfit(spark, [(text, info)]) == ([] if good else ["v"])
    assert spark.createDataFrame([(text,)], "t string").select(violation(F.col("t"), info)).first()[0] == (not good)


def test_null_into_a_required_column_is_a_violation(spark):
    df = spark.createDataFrame([(None,), ("x",)], "t string")
    flags = [r[0] for r in df.select(violation(F.col("t"), ColumnInfo("v", T.StringType(), nullable=False))).collect()]
    assert flags == [True, False]


def options(tmp_path, uid="run-1", **extra):
    return RunOptions(uid, SEED, DAY, str(tmp_path / "out"), **extra)


def dataset(spark, overlay=KEY, df=None):
    return Tables({"demo": {"people": people(spark) if df is None else df}}, {"demo": {"people": overlay}})


def test_run_and_report(spark, tmp_path):
    lines = []
    run = Run(spark, policy(ignore={"where": "id = 1"}), dataset(spark), options(tmp_path, progress=lines.append))
    report = run.execute()
    assert (report.result, report.tablesDone, report.tablesTotal, report.rowsDone) == ("ok", 1, 1, 2), run.__dict__.get("error")
    rows = {r["id"]: r["payload"] for r in run.result("demo", "people").collect()}
    assert rows[1] == "first" and rows[3] is None and len(rows[2]) == 64
    assert lines == [{"msg": "progress", "db": "demo", "table": "people", "tablesDone": 1, "tablesTotal": 1,
                      "rowsDone": 2, "stepsDone": 0}]
    row = report.to_df(spark).first()
    assert row["result"] == "ok" and row["class"] is None and row["rowsDone"] == 2
    again = Run(spark, policy(ignore={"where": "id = 1"}), dataset(spark), options(tmp_path)).execute()
    assert again.result == "ok" and again.rowsDone == 2


def test_dry_run_writes_nothing(spark, tmp_path):
    report = Run(spark, policy(), dataset(spark), options(tmp_path, dry_run=True)).execute()
    assert report.result == "ok" and report.tablesTotal == 1 and report.rowsDone == 0
    assert not (tmp_path / "out").exists()


def test_refused_runs_write_nothing(spark, tmp_path):
    for extra in ({"workers": 33}, {"page_size": 50001}):
        assert Run(spark, policy(), dataset(spark), options(tmp_path, **extra)).execute().failure_class == "policy"
    short = RunOptions("x", b"short", DAY, str(tmp_path / "out"))
    assert Run(spark, policy(), dataset(spark), short).execute().exit_code() == 10
    report = Run(spark, policy(), dataset(spark, {}), options(tmp_path)).execute()
    assert report.exit_code() == 11 and "TableWithoutPrimaryKey" in report.message
    assert not (tmp_path / "out").exists()


def test_violating_value_fails_the_chunk_before_it_counts(spark, tmp_path):
    overlay = {**KEY, "columns": {"payload": {"length": 40}}}
    spec = policy([{"name": "payload", "strategy": "address"}], )
    run = Run(spark, spec, dataset(spark, overlay), options(tmp_path))
    report = run.execute()
    if report.result == "ok":
        pytest.skip("all addresses happened to fit")
    assert report.failure_class == "schema" and "first" not in report.message
    assert run.manifest.rows().where("done").count() == 0


def test_policy_change_is_refused_on_resume(spark, tmp_path):
    Run(spark, policy(), dataset(spark), options(tmp_path)).execute()
    other = Run(spark, policy([{"name": "payload", "strategy": "mask"}]), dataset(spark), options(tmp_path)).execute()
    assert other.failure_class == "policy" and "another policy hash" in other.message


def test_resume_neither_skips_nor_repeats(spark, tmp_path):
    df = spark.createDataFrame(
        [(b"t%d" % (i % 3), 9007199254740993 + i, f"v{i}", 0) for i in range(50)],
        "tenant binary, sequence long, value string, hits int",
    )
    plan = TableTransform(
        "demo", "composite", (compile_rule({"name": "value", "strategy": "hash", "consistent": False}),),
        (ColumnInfo("value", T.StringType()),),
        (ColumnInfo("tenant", T.BinaryType()), ColumnInfo("sequence", T.LongType())),
    )
    keyring = Keyring.derive(SEED, "sha256:" + "0" * 64, DAY)
    manifest, key = Manifest(spark, str(tmp_path / "p")), ProgressKey("r", "table", "demo", "composite", "sha256:" + "0" * 64)
    starts = []

    def rewrite(part):
        if len(starts) in (2, 4):
            starts.append(0)
            raise OSError("the driver is lost")
        starts.append(1)
        return transform(part, plan, keyring, mark=True)

    def once():
        return run_chunks(df, rewrite, lambda: key_chunks(df, ("tenant", "sequence"), 5), manifest, key, str(tmp_path / "o"), ("tenant", "sequence"))

    for _ in range(2):
        with pytest.raises(OSError):
            once()
        with pytest.raises(PolicyError):
            committed(manifest, key)
    assert once() == once() == 50 and sum(starts) == 5
    # What a lost run left behind is not read.
    df.write.parquet(str(tmp_path / "o" / "chunk=99"))
    got = committed(Manifest(spark, str(tmp_path / "p")), key).select("sequence", "value")
    want = transform(df, plan, keyring).select("sequence", "value")
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("column,rule", [
    ("a", "range"), ("t", "range"), ("n", "range"), ("d", "range"), ("f", "range"), ("s", "hash"), ("b", "hash"), ("a,s", "hash")])
def test_key_chunks_cover_every_row_once(spark, column, rule):
    df = spark.range(101).selectExpr(
        "if(id % 10 = 3, null, id) a", "timestamp_seconds(id * 977) t", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, id) n",
        "date_add(date '2024-01-01', cast(id as int)) d", "id / 7.0D f", "string(id) s", "cast(string(id) as binary) b", "id")
    key = tuple(column.split(","))
    chunks = key_chunks(df, key, 4)
    assert {c.rule for c in chunks} == {rule} and len(chunks) == 4
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")  # bounds hold in any zone
    try:
        seen = sorted(r["id"] for c in chunks for r in c.rows(df, key).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert seen == list(range(101))
    assert [c.rule for c in key_chunks(df, key, 1)] == ["all"]


def test_file_groups_keep_partitions_and_open_their_files_only(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(100).selectExpr("id", "id % 5 day").repartition(8).write.partitionBy("day").parquet(path)
    df = spark.read.parquet(path)
    chunks = file_chunks(df, 3)
    parts = [sorted(tuple(r) for r in c.rows(df).collect()) for c in chunks]
    assert sorted(sum(parts, [])) == [(i, i % 5) for i in range(100)]
    files = [{r[0] for r in c.rows(df).select("_metadata.file_path").distinct().collect()} for c in chunks]
    assert sum(map(len, files)) == len(set.union(*files)) and all(files)
    assert [c.rule for c in file_chunks(people(spark), 3)] == ["all"]


def test_unverified_keys_must_be_declared_complete(spark):
    check(spark, policy(), KEY, verify_keys=False)
    with pytest.raises(SchemaError):
        check(spark, policy(), {"primaryKey": ["id"]}, verify_keys=False)


def test_a_lost_chunk_is_an_error_and_the_next_run_completes(spark, tmp_path, monkeypatch):
    import veilwright.plans.resume as resume

    df = spark.range(60).selectExpr("id", "string(id) payload")
    spec = policy([{"name": "payload", "strategy": "hash"}])
    real, calls = resume.write_checked, []

    def failing(marked, path):
        calls.append(path)
        if len(calls) == 3:
            raise OSError("lost")
        return real(marked, path)

    def run():
        made = Run(spark, spec, Tables({"demo": {"people": df}}, {"demo": {"people": KEY}}), options(tmp_path, "lost", chunks=5))
        return made, made.execute()

    monkeypatch.setattr(resume, "write_checked", failing)
    first, report = run()
    assert report.result == "error" and report.tablesDone == 0
    with pytest.raises(PolicyError):
        first.result("demo", "people")
    second, report = run()
    assert report.result == "ok" and report.rowsDone == 60 and len(calls) == 6
    assert second.result("demo", "people").count() == second.result("demo", "people").distinct().count() == 60


def test_steps_see_their_own_database_only(spark, tmp_path):
    source = Tables({"one": {"only_here": people(spark)}, "two": {"other": people(spark)}})
    source.enter(spark, "one")
    assert spark.catalog.tableExists("only_here")
    source.leave(spark, "one")
    assert not spark.catalog.tableExists("only_here")


def test_steps_run_once_and_refuse_uncertainty(spark, tmp_path):
    manifest = Manifest(spark, str(tmp_path / "p"))
    key = ProgressKey("r", "step", "demo", "pre:0:s", "sha256:" + "0" * 64)
    assert run_step(spark, "SELECT 'a;b'", manifest, key) is True
    assert run_step(spark, "SELECT no_such_column", manifest, key) is False
    failing = ProgressKey("r", "step", "demo", "pre:1:s", "sha256:" + "0" * 64)
    for _ in range(2):
        with pytest.raises(UncertainStep):
            run_step(spark, "SELECT no_such_column", manifest, failing)
    resolve_step(manifest, failing)
    assert run_step(spark, "SELECT 1", manifest, failing) is False
    with pytest.raises(PolicyError):
        execute(spark, "  ")
    with pytest.raises(PolicyError):
        run_step(spark, "SELECT 1", manifest, ProgressKey("r", "table", "demo", "x", "h"))
    with pytest.raises(PolicyError):
        ProgressKey("", "step", "d", "n", "h")


def test_run_with_steps_and_truncate(spark, tmp_path):
    (tmp_path / "steps").mkdir()
    mark = tmp_path / "mark"
    (tmp_path / "steps" / "before.sql").write_text(
        f"INSERT OVERWRITE DIRECTORY '{mark}' USING parquet SELECT count(*) AS n FROM people")
    ref = {"name": "before", "configMapKeyRef": {"name": "m", "key": "k"}}
    spec = {"steps": [ref], "databases": [{"name": "demo", "pre": [{"name": "before"}], "tables": [
        {"name": "people", "action": "Truncate"}]}]}
    run = Run(spark, spec, dataset(spark), options(tmp_path, steps_dir=str(tmp_path / "steps")))
    report = run.execute()
    assert (report.result, report.stepsDone, report.tablesDone, report.rowsDone) == ("ok", 1, 1, 0)
    assert spark.read.parquet(str(mark)).first()["n"] == 3
    assert run.result("demo", "people").count() == 0 and run.result("demo", "people").columns == ["id", "payload"]
    missing = Run(spark, spec, dataset(spark), options(tmp_path, "r2", steps_dir=str(tmp_path))).execute()
    assert missing.failure_class == "policy"


def test_constants_come_from_bounded_files(spark, tmp_path):
    (tmp_path / "c" / "secret").mkdir(parents=True)
    (tmp_path / "c" / "secret" / "key").write_text("hidden")
    column = {"name": "payload", "strategy": "constant", "params": {"valueFrom": {"name": "secret", "key": "key"}}}
    run = Run(spark, policy([column]), dataset(spark), options(tmp_path, constants_dir=str(tmp_path / "c")))
    assert run.execute().result == "ok"
    assert {r["payload"] for r in run.result("demo", "people").collect()} == {"hidden", None}
    for parts in (("..",), ("a/b",), ("",), ("a", ".."), ("/etc",), (".",), ("a", "../b")):
        with pytest.raises(PolicyError):
            inside(str(tmp_path), *parts)
    assert inside("file:///x", "a", "b.sql") == "file:///x/a/b.sql"
    (tmp_path / "big").write_bytes(b"x" * 11)
    with pytest.raises(PolicyError):
        read_bounded(str(tmp_path / "big"), 10)
    with pytest.raises(PolicyError):
        read_seed(str(tmp_path / "big"))


def test_folder_dataset(spark, tmp_path):
    people(spark).write.parquet(str(tmp_path / "in" / "demo" / "people"))
    people(spark).write.json(str(tmp_path / "json" / "demo" / "people"))
    for fmt, root in (("parquet", "in"), ("json", "json")):
        source = Folder(spark, str(tmp_path / root), fmt, {"demo": {"people": KEY}})
        assert source.databases() == ["demo"] and not source.has_table("demo", "nope")
        run = Run(spark, policy(), source, options(tmp_path, f"run-{fmt}", chunks=3, chunk_by="files"))
        run.options.output += fmt
        report = run.execute()
        assert report.result == "ok" and report.rowsDone == 3, run.__dict__.get("error")
        assert run.result("demo", "people").count() == 3


def test_report_limits_and_safe_messages():
    report = Report("error", "policy", "x" * 600)
    assert len(json.loads(report.to_json())["message"]) == 512 and report.exit_code() == 10
    codes = {"": 1, "transient": 1, "schema": 11, "permission": 12, "unique": 13}
    assert all(Report("error", c).exit_code() == code for c, code in codes.items())
    with pytest.raises(ValueError):
        Report("error", "policy", "ok", policyHash="h" * 5000).to_json()
    assert classify(ValueError("secret value")) == ("transient", "Spark or I/O operation failed")
    assert classify(UniqueError("x"))[0] == "unique"


def test_spark_errors_are_classed_without_their_text(spark):
    try:
        spark.sql("SELECT secret_column FROM VALUES (1) AS t(a)").collect()
    except Exception as error:
        failure_class, message = classify(error)
        assert failure_class == "schema" and "secret_column" not in message


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, None)], "k int, v string")
    row = checks.unique_check(df, ["k"]).first()
    assert (row["rows"], row["null_keys"], row["duplicate_keys"]) == (4, 1, 1)
    one, two = checks.table_checksum(df).first(), checks.table_checksum(df.repartition(5)).first()
    assert one == two and checks.table_checksum(df.where("k = 1")).first()["checksum"] != one["checksum"]
    shifted = spark.createDataFrame([("ab", "c")], "a string, b string"), spark.createDataFrame([("a", "bc")], "a string, b string")
    assert len({checks.table_checksum(s).first()["checksum"] for s in shifted}) == 2
    assert checks.table_checksum(df.limit(0)).first()["checksum"] == Decimal(0)
    with pytest.raises(SchemaError):
        apply.quote_identifier("a`b")
    assert apply.quote_identifier("a$1") == "`a$1`"
    many = spark.range(20).selectExpr("id div 5 as a", "id % 5 as b")
    assert many.where(apply.after_cursor(("a", "b"), (1, 3))).count() == 11
    assert many.where(apply.after_cursor(("a",), (1,))).count() == 10


@pytest.mark.parametrize("key", [["i"], ["l"], ["s", "l"], ["l", "s"], ["i", "b"], ["s"], ["d"]])
@pytest.mark.parametrize("repeated", [0, 1, 5])
def test_keys_in_words_count_like_keys_one_by_one(spark, key, repeated):
    """Integers next to a word's borders, below zero and at the ends of their types; NULL parts; repeated rows."""
    values = [-(2**63), -(2**63) + 1, -65, -64, -63, -1, 0, 1, 62, 63, 64, 65, 127, 128, 2**40, 2**63 - 1]
    rows = [(i, v, f"t{i % 3}", i % 5 - 2, f"{i}.5") for i, v in enumerate(values)]
    rows += rows[:repeated] + [(None, None, "t0", 1, "0"), (None, None, None, None, None), (77, 99, None, None, None)]
    df = spark.createDataFrame(rows, "i int, l long, s string, b int, d string").select(
        "i", "l", "s", F.col("b").cast("tinyint").alias("b"), F.col("d").cast("decimal(9,1)").alias("d"))
    for frame in (df, df.repartition(4), df.limit(0)):
        assert checks.unique_check(frame, key, small=0).collect() == checks._counted_by_key(frame, key).collect()


def test_key_columns_may_bear_any_name(spark):
    df = spark.range(0, 10_000, 1, 4).select(F.col("id").alias("word"), F.lit("x").alias("bit"), F.lit(1).alias("part_0"))
    for key in (["bit", "word"], ["WORD", "part_0"], ["word"]):
        assert tuple(checks.unique_check(df, key, small=0).first()) == tuple(checks.unique_check(df, key).first()) == (10_000, 0, 0)


def test_declared_lengths_are_read_from_the_schema():
    schema = T.StructType([T.StructField("a", T.VarcharType(7)), T.StructField("b", T.StringType(), metadata={
        "__CHAR_VARCHAR_TYPE_STRING": "char(3)"}), T.StructField("c", T.StringType())])
    info = table_info(schema, {"columns": {"C": {"length": 9}}})
    assert [info.column(n).length for n in "abc"] == [7, 3, 9]


def test_null_fits_every_column_type(spark):
    df = spark.sql("SELECT 1L AS id, array(1.0F) AS a, map('k', 1) AS m, named_struct('x', 1) AS s, true AS b")
    names = ["a", "m", "s", "b"]
    info = table_info(df.schema)
    plan = TableTransform("demo", "t", tuple(compile_rule({"name": n, "strategy": "null"}) for n in names),
                          tuple(info.column(n) for n in names), (info.column("id"),))
    keyring = Keyring.derive(SEED, "sha256:" + "0" * 64, DAY)
    out = transform(df, plan, keyring)
    assert tuple(out.first()) == (1, None, None, None, None)
    assert [f.dataType for f in out.schema] == [f.dataType for f in df.schema]


def test_links_count_no_null_keys(spark):
    child = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None), (None, "c")], "k int, v string")
    parent = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (None, "c")], "id int, name string")
    row = checks.link_preserved(child, parent, [("k", "id"), ("v", "name")]).first()
    assert (row["child_rows"], row["linked_rows"]) == (5, 2)


def spread_files(spark, tmp_path, rows=400, files=16):
    """A table that is not clustered by its key: every file holds keys of the whole range."""
    path = str(tmp_path / "in" / "demo" / "people")
    spark.range(rows).selectExpr("id", "'v' || id payload").repartition(files).write.parquet(path)
    return path


def test_packs_of_files_read_no_file_twice(spark, tmp_path):
    df = spark.read.parquet(spread_files(spark, tmp_path))
    chunks = packed_chunks(df, str(tmp_path / "plan"), size=100)
    assert 3 <= len(chunks) <= 5 and {c.rule for c in chunks} == {"packed"}
    files = [{r[0] for r in c.rows(df).select("_metadata.file_path").distinct().collect()} for c in chunks]
    assert sum(map(len, files)) == len(set.union(*files)) == 16
    assert sorted(r["id"] for c in chunks for r in c.rows(df).collect()) == list(range(400))
    # The files of other chunks are not opened: the scan lists its own only.
    scan = chunks[0].rows(df)
    assert len(scan.inputFiles()) >= len(files[0]) and scan.rdd.getNumPartitions() <= len(files[0])
    assert len(packed_chunks(df, str(tmp_path / "one"), count=1)) == 1
    assert packed_chunks(df.where("id < 0"), str(tmp_path / "none"), size=10)[0].rule in ("all", "packed")


def test_many_groups_of_packs_cover_all_files(spark, tmp_path, monkeypatch):
    import veilwright.plans.resume as resume

    monkeypatch.setattr(resume, "PACKS", 2)
    df = spark.read.parquet(spread_files(spark, tmp_path))
    chunks = packed_chunks(df, str(tmp_path / "plan"), size=30)
    assert len(chunks) > 6 and len({c.index for c in chunks}) == len(chunks)
    assert sorted(r["id"] for c in chunks for r in c.rows(df).collect()) == list(range(400))


def test_page_size_makes_the_chunks(spark, tmp_path):
    spread_files(spark, tmp_path)
    source = Folder(spark, str(tmp_path / "in"), overlays={"demo": {"people": KEY}})
    numbers = {}
    for size in (10, 50, None):
        run = Run(spark, policy(), source, options(tmp_path, f"pages-{size}", page_size=size, pages=4))
        run.options.output += str(size)
        assert run.execute().result == "ok", run.__dict__.get("error")
        rows = run.manifest.rows().where("not done")
        numbers[size] = rows.count()
        assert {r["rule"] for r in rows.collect()} == {"packed"} and run.result("demo", "people").count() == 400
    assert numbers[10] > numbers[50] > numbers[None] == 1
    # A table's own setting comes first, and rows that come from no file are cut by key into as many chunks.
    frame = spark.createDataFrame([(i, "x") for i in range(100)], "id long, payload string")
    run = Run(spark, policy(pageSize=5), dataset(spark, df=frame), options(tmp_path, "by-key", page_size=100, pages=4))
    assert run.execute().result == "ok" and run.manifest.rows().where("not done AND rule = 'range'").count() == 5
    for wrong in ({"pages": 0}, {"chunks": 0}, {"chunk_by": "rows"}):
        assert Run(spark, policy(), dataset(spark), options(tmp_path, "wrong", **wrong)).execute().failure_class == "policy"


def test_a_lost_packed_run_goes_on(spark, tmp_path, monkeypatch):
    import veilwright.plans.resume as resume

    spread_files(spark, tmp_path)
    source = Folder(spark, str(tmp_path / "in"), overlays={"demo": {"people": KEY}})
    real, calls = resume.write_checked, []

    def failing(marked, path, *layout):
        calls.append(path)
        if len(calls) == 3:
            raise OSError("lost")
        return real(marked, path, *layout)

    monkeypatch.setattr(resume, "write_checked", failing)
    make = lambda: Run(spark, policy(), source, options(tmp_path, "packed", page_size=20, pages=4))
    assert make().execute().result == "error"
    second = make()
    assert second.execute().result == "ok"
    planned = second.manifest.rows().where("not done").count()
    assert planned >= 4 and len(calls) == planned + 1
    assert sorted(r["id"] for r in second.result("demo", "people").collect()) == list(range(400))


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_format_and_partitions_are_kept(spark, tmp_path, fmt):
    path = tmp_path / "in" / "demo" / "people"
    rows = spark.range(60).selectExpr("id", "'v' || id payload", "id % 3 part", "id % 2 half")
    rows.repartition(2).write.partitionBy("part", "half").format(fmt).save(str(path))
    source = Folder(spark, str(tmp_path / "in"), fmt, {"demo": {"people": KEY}})
    assert source.layout("demo", "people") == (fmt, ("part", "half"))
    run = Run(spark, policy([{"name": "payload", "strategy": "mask"}]), source, options(tmp_path, page_size=5, pages=4))
    assert run.execute().result == "ok", run.__dict__.get("error")
    out = run.result("demo", "people")
    assert out.schema == source.table("demo", "people").schema
    assert sorted(tuple(r) for r in out.select("id", "payload", "part", "half").collect()) == [
        (i, "*" * (1 + len(str(i))), i % 3, i % 2) for i in range(60)]
    made = [p for p in (tmp_path / "out" / "demo" / "people").rglob(f"*.{fmt}") if "_plan" not in p.parts]
    assert made and all(p.parent.name.startswith("half=") and p.parent.parent.name.startswith("part=") for p in made)


def test_two_drivers_of_one_run(spark, tmp_path):
    """Two manifests over one folder, both empty when they are read: one executes the step, both may write, one counts."""
    first, second = Manifest(spark, str(tmp_path / "p")), Manifest(spark, str(tmp_path / "p"))
    step = ProgressKey("r", "step", "demo", "pre:0:s", "sha256:" + "0" * 64)
    assert first.entries(step) == second.entries(step) == []
    assert first.claim(step, "a") and not second.claim(step, "a") and second.claim(step, "b")
    assert run_step(spark, f"INSERT OVERWRITE DIRECTORY '{tmp_path / 'rows'}' USING parquet SELECT 1 AS n", first, step) is True
    assert run_step(spark, "SELECT no_such_column", second, step) is False
    # A driver that has begun and not ended.
    begun = ProgressKey("r", "step", "demo", "pre:1:s", "sha256:" + "0" * 64)
    assert second.entries(begun) == [] and first.claim(begun)
    with pytest.raises(UncertainStep):
        run_step(spark, "SELECT 1", second, begun)
    # Chunks: both write, to two places, and readers see one.
    df = spark.range(40).selectExpr("id", "'v' || id payload")
    info = table_info(df.schema)
    plan = TableTransform("demo", "t", (compile_rule({"name": "payload", "strategy": "mask"}),), (info.column("payload"),), (info.column("id"),))
    keyring = Keyring.derive(SEED, "sha256:" + "0" * 64, DAY)
    table = ProgressKey("r", "table", "demo", "t", "sha256:" + "0" * 64)
    for manifest in (first, second):
        manifest.entries(table)
    rewrite = lambda part: transform(part, plan, keyring, mark=True)
    chunks = lambda: [Chunk(0, "hash", 2), Chunk(1, "hash", 2)]
    for manifest in (first, second):
        assert run_chunks(df, rewrite, chunks, manifest, table, str(tmp_path / "o"), ("id",)) == 40
    third = Manifest(spark, str(tmp_path / "p"))
    assert len({r["path"] for r in third.entries(table) if r["done"]}) == 4
    assert committed(third, table).count() == committed(first, table).count() == 40
    from veilwright.plans.runner import run_totals

    totals = {r["kind"]: r for r in run_totals(third, "r").collect()}
    assert totals["table"]["units_done"] == 2 and totals["table"]["rows_done"] == 40


def test_errors_of_the_data_are_no_transient_ones(spark, tmp_path):
    frame = spark.createDataFrame([(i, str(i - 2)) for i in range(5)], "id long, payload string")
    for uid, where in (("zero", "1 div cast(payload as int) = 1"), ("cast", "cast(payload || 'x' as int) = 1")):
        report = Run(spark, policy(ignore={"where": where}), dataset(spark, df=frame), options(tmp_path, uid)).execute()
        assert report.failure_class == "schema" and report.exit_code() == 11, report.message


def test_files_behind_uris_are_read_as_spark_reads_them(spark, tmp_path):
    (tmp_path / "seed").write_bytes(b"s" * 40)
    assert read_bounded(f"file://{tmp_path}/seed") == b"s" * 40 == read_seed(f"file://{tmp_path}/seed")
    for path, most in ((f"file://{tmp_path}/none", 100), (f"file://{tmp_path}/seed", 39), ("nosuchscheme://x/y", 10)):
        with pytest.raises(PolicyError):
            read_bounded(path, most)


def test_tables_of_a_server_need_ranges(spark):
    from veilwright.sources.dataset import Jdbc

    with pytest.raises(SchemaError, match="bounds"):
        Jdbc(spark, "jdbc:none:", {"demo": ["t"]}, {}).table("demo", "t")


def test_the_catalog_goes_back_to_its_database(spark):
    from veilwright.sources.dataset import Catalog

    spark.sql("CREATE DATABASE IF NOT EXISTS elsewhere")
    source, before = Catalog(spark), spark.catalog.currentDatabase()
    source.enter(spark, "elsewhere")
    assert spark.catalog.currentDatabase() == "elsewhere"
    source.leave(spark, "elsewhere")
    assert spark.catalog.currentDatabase() == before


def test_checksums_of_chunks_add_up(spark, tmp_path, monkeypatch):
    """A lost run and a lost proof go on; sums equal one pass; only open chunks are read again."""
    import veilwright.plans.resume as resume

    df = spark.range(60).selectExpr("id", "if(id % 7 = 0, null, 'v' || id) payload", "timestamp_seconds(id) at", "id / 7 share")
    df.repartition(6).write.parquet(str(tmp_path / "in" / "demo" / "people"))
    source = Folder(spark, str(tmp_path / "in"), overlays={"demo": {"people": KEY}})
    make = lambda **more: Run(spark, policy(), source, options(tmp_path, "sums", page_size=10, pages=1, **more))
    dry = make(dry_run=True)
    assert dry.execute().result == "ok"
    real, calls = resume.table_checksum, []

    def failing(rows, *rest):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("lost")
        return real(rows, *rest)

    monkeypatch.setattr(resume, "table_checksum", failing)
    with pytest.raises(OSError):
        dry.prove_source("demo", "people", "before")
    before = dry.prove_source("demo", "people", "before")
    assert tuple(before) == tuple(real(source.table("demo", "people")).first())
    count = len(calls)
    assert dry.prove_source("demo", "people", "before") == before and len(calls) == count
    run = make(checksums=True)
    assert run.execute().result == "ok"
    # Another driver's session may show instants in another zone.
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert tuple(run.checksum("demo", "people")) == tuple(real(run.result("demo", "people")).first())
        again = make(checksums=True)
        assert again.execute().result == "ok" and again.checksum("demo", "people") == run.checksum("demo", "people") != before
        assert again.prove_source("demo", "people", "after") == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_chunks_without_checksums_are_refused(spark, tmp_path):
    run = Run(spark, policy(), dataset(spark), options(tmp_path, "plain"))
    assert run.execute().result == "ok"
    with pytest.raises(PolicyError):
        run.checksum("demo", "people")

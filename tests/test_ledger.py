import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilwright.errors import PolicyError
from veilwright.operators import ledger
from veilwright.sources import documents, fixtures

T0 = dt.datetime(2026, 1, 1)
BACKUP = (
    "name string, cluster string, state string, created_at timestamp, completed_at timestamp, destination string, "
    "spec_storage string, status_storage string, run_uid string, has_owner_reference boolean, is_current boolean"
)


def at(hours):
    return None if hours is None else T0 + dt.timedelta(hours=hours)


def backups(spark, *rows):
    """rows of (name, state, created, completed[, extra])"""
    made = []
    for name, state, created, completed, *extra in rows:
        values = {"cluster": "c", "destination": f"s3://b/{name}", "spec": "", "status": "s1", "run": "r1",
                  "owned": False, "current": False, **(extra[0] if extra else {})}
        made.append((name, values["cluster"], state, at(created), at(completed), values["destination"], values["spec"],
                     values["status"], values["run"], values["owned"], values["current"]))
    return spark.createDataFrame(made, BACKUP)


def selected(df):
    row = ledger.latest_succeeded(df, ["cluster"]).first()
    return row and (row["selected"], row["succeeded"], row["missing_completion"])


def test_latest_succeeded(spark):
    assert selected(backups(spark)) is None
    assert selected(backups(spark, ("a", "Succeeded", 5, None))) == (None, 1, 1)
    assert selected(backups(spark, ("a", "Succeeded", 9, 1), ("b", "Succeeded", 0, 2))) == ("b", 2, 0)
    assert selected(backups(spark, ("a", "Succeeded", 1, 3), ("b", "Succeeded", 2, 3))) == ("b", 2, 0)
    assert selected(backups(spark, ("b", "Succeeded", 1, 3), ("a", "Succeeded", 1, 3))) == ("a", 2, 0)
    assert selected(backups(spark, ("a", "Failed", 1, 9), ("b", "Running", 1, 9), ("c", "Succeeded", 1, 2))) == ("c", 1, 0)


@pytest.mark.parametrize("rows,reason", [
    ([("ok", "Succeeded", 1, 2)], "LatestSucceeded"),
    ([("ok", "Succeeded", 1, 2), ("x", "Failed", 1, None)], "LatestSucceeded"),
    ([("ok", "Succeeded", 1, 2), ("x", "Failed", 3, None), ("y", "Running", 4, None)], "NewerBackupFailed"),
    ([("ok", "Succeeded", 1, 2), ("y", "Running", 4, None), ("z", "Starting", 5, None)], "NewerBackupInProgress"),
])
def test_selection_reason(spark, rows, reason):
    row = ledger.selection_reason(backups(spark, *rows), ["cluster"]).first()
    assert row["reason"] == reason and row["selected"] == "ok"
    if reason == "NewerBackupInProgress":
        assert row["message"] == "newer backup z is in progress; selected successful backup ok"


def test_counts_filters_and_reasons(spark):
    table = backups(spark, ("a", "Succeeded", 1, 2, {"destination": "pvc/a"}), ("b", "Failed", 1, None, {"spec": "s9"}),
                    ("c", "Odd", 1, None))
    row = ledger.state_counts(table, ["cluster"]).first()
    assert (row["succeeded"], row["failed"], row["running"], row["starting"]) == (1, 1, 0, 0)
    assert [r["name"] for r in ledger.candidate_filter(table, "c", ["s9"]).collect()] == ["b"]
    assert ledger.candidate_filter(table, "other").count() == 0
    for current, phase in ((None, "NoCandidate"), ("b", "NoCandidate"), ("gone", "Dangling")):
        published = spark.createDataFrame([("c", current)], "cluster string, current string")
        assert ledger.no_candidate_reason(table, published, ["cluster"]).first()["phase"] == phase


def test_freshness_boundary(spark):
    found = ledger.latest_succeeded(backups(spark, ("a", "Succeeded", 0, 0)), ["cluster"])
    for hours, fresh in ((35.99, True), (36, False)):
        now = F.lit(T0 + dt.timedelta(hours=hours))
        assert ledger.freshness(found, now).first()["fresh"] is fresh


def test_retention(spark):
    table = backups(
        spark, ("s1", "Succeeded", 1, 10), ("s2", "Succeeded", 1, 9), ("s3", "Succeeded", 1, 8),
        ("s4", "Succeeded", 1, 7, {"current": True}), ("s5", "Succeeded", 1, 6, {"run": "r2"}),
        ("s6", "Succeeded", 1, 5, {"owned": True}), ("s7", "Succeeded", 1, 4, {"run": "unknown"}),
        ("f1", "Failed", 0, None), ("f2", "Failed", 1, None), ("r1", "Running", 0, None),
    )
    owners = spark.createDataFrame([("r1", True), ("r2", False)], "run_uid string, settled boolean")
    now = F.lit(at(24))
    doomed = {r["name"] for r in ledger.retention_prune(table, owners, ["cluster"], now).collect()}
    assert doomed == {"s3", "f1"}
    everything = {r["name"] for r in ledger.retention_prune(table, owners, ["cluster"], now, keep=1, failed_after_hours=1).collect()}
    assert everything == {"s2", "s3", "f1", "f2"}


RUN = (
    "name string, schedule string, phase string, created_at timestamp, completed_at timestamp, deleted_at timestamp, "
    "cleaned_up boolean, retained boolean"
)


def test_runs(spark):
    rows = [
        ("c1", "s", "Completed", at(0), at(1), None, True, False),
        ("c2", "s", "Completed", at(5), None, None, False, True),
        ("c3", "s", "Completed", at(0), at(3), None, True, None),
        ("c4", "s", "Completed", at(9), at(9), None, False, False),
        ("c5", "s", "Completed", at(0), at(0), at(1), True, False),
        ("f1", "s", "Failed", at(0), at(1), None, True, False),
        ("a1", "s", "Restoring", at(8), None, None, None, None),
    ]
    table = spark.createDataFrame(rows, RUN).withColumn("settled", ledger.settled())
    assert {r["name"] for r in table.where("settled").collect()} == {"c1", "c2", "c3", "f1"}
    doomed = lambda done, failed: {r["name"] for r in ledger.history_prune(table, ["schedule"], done, failed).collect()}
    assert doomed(1, 1) == {"c1", "c3"} and doomed(3, 0) == {"f1"} and doomed(0, 5) == {"c1", "c2", "c3"}
    row = ledger.run_status_rollup(table, ["schedule"]).first()
    assert (row["active_count"], row["last_run"], row["last_phase"], row["last_success"]) == (3, "c4", "Completed", at(9))
    assert {r["name"] for r in ledger.active_runs(table, ["schedule"]).collect()} == {"a1", "c4", "c5"}


def test_one_group_spreads_over_tasks(spark):
    """A group that holds every row gives the same answer through the salted join."""
    rows = spark.range(1000).select(F.lit("g").alias("k"), "id")
    answer = spark.createDataFrame([("g", 7)], "k string, v int")
    joined = ledger.meet(rows, answer, ["k"])
    assert joined.count() == 1000 and joined.select("id").distinct().count() == 1000


def test_one_group_with_ties_has_one_winner_and_no_salted_join(spark):
    """All rows in one group, a third of them tied: the first by creation, then by name."""
    done, early, late = (F.timestamp_seconds(F.lit(n)) for n in (5000, 100, 200))
    rows = spark.range(900).select(
        F.lit("g").alias("cluster"), F.concat(F.lit("b"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("name"),
        F.lit("Succeeded").alias("state"), F.lit("s3://b/k").alias("destination"),
        F.when(F.col("id") % 2 == 0, late).otherwise(early).alias("created_at"),
        F.when(F.col("id") % 3 == 0, done).otherwise(F.timestamp_seconds(F.col("id"))).alias("completed_at"))
    found = ledger.latest_succeeded(rows, ["cluster"])
    assert (found.first()["selected"], found.first()["succeeded"]) == ("b0000", 900)
    plan = found._jdf.queryExecution().toString()
    assert "__salt" not in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("destination,good", [
    ("s3://b/k", True), ("s3://b/a/b c", True), ("s3://b/", False), ("s3://b", False), ("http://b/k", False),
    ("s3://u@b/k", False), ("s3://u:p@b/k", False), ("s3://b/k?x", False), ("s3://b/k?", False), ("s3://b/k#f", False),
    ("s3:///k", False), ("", False), (None, False), ("s3://b/%zz", False), ("s3://b/%41", True),
])
def test_destinations(spark, destination, good):
    df = spark.createDataFrame([(destination,)], "d string")
    assert df.select(documents.valid_destination(F.col("d"))).first()[0] is good


def test_pointers(spark):
    texts = [
        '{"name":"n","destination":"s3://b/k"}',
        '{"name":"n","destination":"s3://b/k","schemaVersion":2,"s3":{"bucket":"b","endpointUrl":"ftp://x"}}',
        '{"name":"n","destination":"s3://b/k","publicURL":"https://x/y"}',
        '{"name":"n","destination":"s3://b/k","schemaVersion":"two"}',
        '{"name":"n"',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    rows = documents.write_pointers(documents.read_pointers(df)).orderBy("i").collect()
    assert [r["valid"] for r in rows] == [True, False, True, False, False]
    assert rows[0]["json"] == '{"name":"n","destination":"s3://b/k","schemaVersion":2}' and rows[1]["json"] is None
    ages = spark.createDataFrame([(1, None, 1), (2, None, 2), (3, at(0), 2), (4, at(30), 2)], "i int, published_at timestamp, schema_version int")
    got = {r["i"]: (r["accepted"], r["warning"]) for r in ledger.pointer_max_age(ages, F.lit(at(24)), 24).collect()}
    assert got == {1: (True, "LegacyPointerAgeUnknown"), 2: (False, None), 3: (True, None), 4: (False, None)}
    with pytest.raises(ValueError):
        ledger.pointer_max_age(ages, F.lit(at(1)), 0)


def test_demo_dataset(spark, tmp_path):
    tables = fixtures.build(spark)
    user, commission = tables["demo_users"]["user"], tables["demo_orders"]["commission"]
    identity, address = tables["demo_orders"]["commission_identity"], tables["demo_users"]["address"]
    joined = commission.alias("c").join(user.alias("u"), F.expr("u.id = c.user_id")).join(
        identity.alias("i"), F.expr("i.commission_id = c.id"))
    same = "c.email = u.email AND c.given_name = u.given_name AND c.family_name = u.family_name AND i.email = c.email"
    assert joined.where(same).count() == 10000
    assert address.alias("a").join(user.alias("u"), F.expr("u.id = a.user_id AND u.phone = a.phone")).count() == 8000
    blacklist = tables["demo_users"]["email_blacklist"]
    assert blacklist.join(user, ["id", "email"]).count() == 300
    assert tables["demo_content"]["message_property"].where("key = 'robots.txt'").first()["value"] == "User-agent: *\nDisallow: /"
    root = str(tmp_path / "demo")
    assert fixtures.seed(spark, root) is False and fixtures.seed(spark, root) is True
    assert spark.read.parquet(f"{root}/demo_orders/audit_log").count() == 2
    with pytest.raises(PolicyError):
        fixtures.seed(spark, root, 2)
    with pytest.raises(PolicyError):
        fixtures.numbers(spark, "user", 11)
    half = str(tmp_path / "half")
    user.write.parquet(f"{half}/demo_users/user")
    with pytest.raises(PolicyError):
        fixtures.seed(spark, half)


def _backup(name, created, completed):
    day = lambda d: None if d is None else dt.datetime(2024, 1, d, tzinfo=dt.timezone.utc)
    return (name, "c", "Succeeded", day(created), day(completed), "r", False, False)


def test_completions_compare_with_completions_only(spark):
    schema = ("name string, cluster string, state string, created_at timestamp, completed_at timestamp, run_uid string, "
              "has_owner_reference boolean, is_current boolean")
    owners = spark.createDataFrame([("r", True)], "run_uid string, settled boolean")
    now = F.lit("2024-02-01").cast("timestamp")
    for rows, gone in (
        ([_backup("a", 10, 20), _backup("b", 15, None)], {"a"}),
        ([_backup("a", 10, 20), _backup("b", 15, 16)], {"b"}),
        ([_backup("a", 10, 20), _backup("b", 15, 20)], {"a"}),
        ([_backup("a", 10, None), _backup("b", 10, None)], {"b"}),
    ):
        doomed = ledger.retention_prune(spark.createDataFrame(rows, schema), owners, ["cluster"], now, keep=1)
        assert {r["name"] for r in doomed.collect()} == gone


def test_text_after_a_document_and_bad_times_are_refused(spark):
    good = '{"name":"n","destination":"s3://b/k"%s}'
    texts = [(good % "", True), (good % "" + " \n", True), (good % "" + "{}", False), (good % "" + ",{}", False), (good % "" + " x", False),
             (good % ',"publishedAt":"2024-01-02T03:04:05Z"', True), (good % ',"publishedAt":"2024-01-02T03:04:05.25+01:00"', True),
             (good % ',"publishedAt":"2024-01-02"', False), (good % ',"publishedAt":"soon"', False),
             (good % ',"publishedAt":"2024-13-02T03:04:05Z"', False), (good % ',"backup":{"completedAt":"x"}', False)]
    df = spark.createDataFrame(texts, "value string, fine boolean")
    assert documents.read_pointers(df).where("valid <> fine").count() == 0
    lines = spark.createDataFrame([(1, '{"msg":"ok"}'), (2, '{"msg":"ok"} '), (3, '{"msg":"ok"}{}'), (4, '{"msg":"ok"} more')], "n int, value string")
    assert sorted(r["n"] for r in documents.parse_logs(lines).collect()) == [1, 2]


def test_selections_sort_no_whole_group(spark):
    backups = spark.createDataFrame([_backup("a", 1, 2)], (
        "name string, cluster string, state string, created_at timestamp, completed_at timestamp, destination string, x boolean, y boolean"))
    runs = backups.selectExpr("name", "cluster", "state phase", "true settled", "created_at", "completed_at")
    logs = spark.createDataFrame([("r", 1, "progress", "d", "t", "", "", 1, 1, 1, 1)], (
        "run string, line_no long, msg string, db string, table string, step string, name string, tablesDone int, tablesTotal int, "
        "rowsDone long, stepsDone int"))
    for df in (ledger.latest_succeeded(backups, ["cluster"]), ledger.run_status_rollup(runs, ["cluster"]), ledger.latest_progress(logs, ["run"])):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 1

import datetime as dt
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwright import Catalog, Run, RunOptions
from veilwright.__main__ import main
from veilwright.functions.text import pk_json
from veilwright.plans.runner import run_totals

OVERLAYS = {"demo_users": {t: {"primaryKey": ["id"], "columns": {"id": {"nullable": False}}} for t in ("user", "address")}}
POLICY = {
    "defaults": {"emailDomain": "example.com"},
    "databases": [
        {"namePattern": "demo_u.*", "tables": [
            {"name": "user", "columns": [
                {"name": "email", "strategy": "email"}, {"name": "given_name", "strategy": "firstName"},
                {"name": "birthday", "strategy": "date", "params": {"to": "2000-12-31"}},
                {"name": "phone", "strategy": "phone"}, {"name": "password", "strategy": "hash"}]},
            {"name": "address", "columns": [
                {"name": "phone", "strategy": "phone"}, {"name": "street", "strategy": "streetAddress"}]},
            {"name": "email_blacklist", "action": "Truncate"}]},
    ],
}


def test_seed_and_anonymize(spark, tmp_path, capsys):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert main(["seed-demo", "--output", source], spark) == 0
    assert main(["seed-demo", "--output", source, "--scale", "2"], spark) == 1
    files = {"policy": json.dumps(POLICY), "overlays": json.dumps(OVERLAYS), "seed": "s" * 32, "short": "s"}
    paths = {}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
        paths[name] = str(tmp_path / name)
    base = ["anonymize", "--policy", paths["policy"], "--overlays", paths["overlays"], "--run-uid", "r1",
            "--reference-time", "2026-01-02", "--input", source, "--output", out, "--chunks", "3"]
    assert main([*base, "--seed-file", paths["short"]], spark) == 10
    assert main([*base, "--seed-file", paths["seed"], "--dry-run"], spark) == 0
    assert not (tmp_path / "out").exists()
    assert main([*base, "--seed-file", paths["seed"], "--report", str(tmp_path / "report")], spark) == 0
    report = json.loads((tmp_path / "report").read_text())
    assert (report["tablesDone"], report["rowsDone"], report["result"]) == (3, 13000, "ok")
    users = spark.read.parquet(*[f"{out}/demo_users/user/chunk={i}" for i in range(3)])
    addresses = spark.read.parquet(*[f"{out}/demo_users/address/chunk={i}" for i in range(3)])
    joined = addresses.alias("a").join(users.alias("u"), F.expr("a.user_id = u.id AND a.phone = u.phone"))
    assert users.count() == 5000 and joined.count() == 8000
    assert users.where("email RLIKE '-[0-9a-f]{12}@example[.]com$'").count() == 5000
    # Another seed under the same run is refused; so is a run that draws its own.
    (tmp_path / "other").write_text("o" * 32)
    assert main([*base, "--seed-file", str(tmp_path / "other")], spark) == 10
    assert main(base, spark) == 10
    capsys.readouterr()


def test_catalog_dataset_and_fresh_seed(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    spark.sql("CREATE TABLE shop.client (id BIGINT NOT NULL, name VARCHAR(10), code STRING) USING parquet")
    spark.sql("INSERT INTO shop.client VALUES (1, 'Ann', 'x'), (2, NULL, 'y')")
    spark.sql("CREATE VIEW shop.seen AS SELECT * FROM shop.client")
    overlays = {"shop": {t: {"primaryKey": ["id"], "columns": {"id": {"nullable": False}}} for t in ("client", "seen")}}
    source = Catalog(spark, overlays)

    def execute(table, column, uid):
        spec = {"databases": [{"name": "shop", "tables": [{"name": table, "columns": [column]}]}]}
        run = Run(spark, spec, source, RunOptions(uid, None, dt.date(2026, 1, 2), str(tmp_path / uid)))
        return run, run.execute()

    assert execute("seen", {"name": "code", "strategy": "hash"}, "a")[1].failure_class == "schema"
    assert execute("client", {"name": "name", "strategy": "hash"}, "b")[1].failure_class == "schema"
    run, report = execute("client", {"name": "name", "strategy": "hash", "params": {"length": 10}}, "c")
    assert report.result == "ok" and report.rowsDone == 2
    rows = {r["id"]: r["name"] for r in run.result("shop", "client").collect()}
    assert len(rows[1]) == 10 and rows[2] is None
    totals = run_totals(run.manifest, "c").first()
    assert (totals["name"], totals["units_done"], totals["rows_done"]) == ("client", 1, 2)
    spark.sql("DROP DATABASE shop CASCADE")
    spark.catalog.setCurrentDatabase("default")


def test_key_json(spark):
    moment = dt.datetime(2024, 5, 6, 7, 8, 9, 500000)
    df = spark.createDataFrame(
        [(9007199254740993, "a<b", b"\x00\xff", moment, moment.date(), True)],
        "i long, s string, b binary, t timestamp_ntz, d date, f boolean",
    )
    text = pk_json([(F.col(f.name), f.dataType) for f in df.schema])
    want = '[9007199254740993,\\"YTxi\\",\\"AP8=\\",\\"2024-05-06T07:08:09.5Z\\",\\"2024-05-06T00:00:00Z\\",true]'
    assert df.select(text).first()[0] == want
    decimal = spark.sql("SELECT CAST(1.50 AS DECIMAL(5,2)) AS m")
    assert decimal.select(pk_json([(F.col("m"), T.DecimalType(5, 2))])).first()[0] == '[\\"MS41MA==\\"]'

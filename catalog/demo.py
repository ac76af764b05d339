"""Inputs shared by the registered queries and their SQL twins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright import ColumnInfo, Keyring, TableTransform, compile_rule, table_info

SEED = b"a demo seed of at least 32 bytes, not a secret"
POLICY_HASH = "sha256:" + "5a" * 32
REFERENCE_DATE = dt.date(2026, 1, 2)
KEYRING = Keyring.derive(SEED, POLICY_HASH, REFERENCE_DATE)
NOW = "2024-01-31 00:00:00"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    # Times without a zone are read as UTC everywhere.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def now():
    return F.lit(NOW).cast("timestamp")


def plan_for(
    df: DataFrame, table: str, columns: list[dict], key: list[str] = (), where: str | None = None,
    overlay: dict | None = None, defaults: dict | None = None, unique=(),
) -> TableTransform:
    info = table_info(df.schema, overlay)
    rules = tuple(compile_rule(c, defaults) for c in columns)
    targets: tuple[ColumnInfo, ...] = tuple(info.column(c["name"]) for c in columns)
    plan = TableTransform("demo", table, rules, targets, tuple(info.column(k) for k in key), where, unique)
    plan.check()
    return plan


def backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backup ledger read off the events: one backup per event."""
    i = F.col("event_id")
    state = (
        F.when(F.col("event_type") == "purchase", "Succeeded").when(F.col("event_type") == "error", "Failed")
        .when(F.col("event_type") == "view", "Running").when(F.col("event_type") == "click", "Starting")
        .otherwise("Queued")
    )
    created = F.col("ts").cast("timestamp")
    done = (F.col("event_type") == "purchase") & (i % 11 != 0)
    return load(spark, sf_dir, "events").select(
        F.concat(F.lit("backup-"), i.cast("string")).alias("name"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("cluster"),
        state.alias("state"),
        created.alias("created_at"),
        F.when(done, F.timestamp_add("SECOND", i % 7200, created)).alias("completed_at"),
        F.concat(F.when(i % 13 == 0, "pvc/").otherwise("s3://bucket/"), i.cast("string")).alias("destination"),
        F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("s"), (i % 3).cast("string"))).alias("spec_storage"),
        F.concat(F.lit("s"), (i % 4).cast("string")).alias("status_storage"),
        F.concat(F.lit("run-"), (i % 97).cast("string")).alias("run_uid"),
        (i % 17 == 0).alias("has_owner_reference"),
        (i % 101 == 0).alias("is_current"),
    )


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that own those backups."""
    uid = F.col("event_id") % 97
    return load(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), uid.cast("string")).alias("run_uid"), (uid % 3 != 0).alias("settled")
    ).distinct()


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run ledger read off the events: one run per event."""
    from veilwright.operators import ledger

    i = F.col("event_id")
    created = F.col("ts").cast("timestamp")

    def later(seconds, when=None):
        moment = F.timestamp_add("SECOND", seconds, created)
        return moment if when is None else F.when(when, moment)

    phase = (
        F.when(F.col("event_type").isin("purchase", "signup"), "Completed").when(F.col("event_type") == "error", "Failed")
        .when(F.col("event_type") == "view", "Anonymizing").otherwise("Pending")
    )
    terminal = F.col("event_type").isin("purchase", "signup", "error")
    table = load(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), i.cast("string")).alias("name"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("schedule"),
        phase.alias("phase"),
        created.alias("created_at"),
        later(i % 5000, terminal & (i % 9 != 0)).alias("completed_at"),
        later(F.lit(1), i % 19 == 0).alias("deleted_at"),
        (i % 3 != 0).alias("cleaned_up"),
        (i % 7 == 0).alias("retained"),
        later(i % 100).alias("ready_at"),
        later(F.lit(50), i % 4 != 0).alias("restored_at"),
        later(F.lit(60)).alias("anonymize_started_at"),
        later(F.lit(60) + i % 900, i % 6 != 0).alias("anonymize_completed_at"),
        later(F.lit(500), i % 2 == 0).alias("output_completed_at"),
        later(F.lit(600)).alias("backed_up_at"),
        later(F.lit(590) + i % 30).alias("published_at"),
    )
    return table.withColumn("settled", ledger.settled())


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log read off the events: progress, step outcomes and broken lines."""
    i = F.col("event_id")
    kind = i % 10
    progress = F.concat(
        F.lit('{"msg":"progress","db":"demo","table":"'), F.col("event_type"), F.lit('","tablesDone":'),
        (i % 7).cast("string"), F.lit(',"tablesTotal":'), (i % 5 + 1).cast("string"), F.lit(',"rowsDone":'),
        (i * 10).cast("string"), F.lit(',"stepsDone":'), (i % 3).cast("string"), F.lit("}"),
    )
    line = (
        F.when(kind == 0, "plain text, not JSON").when(kind == 1, '{"msg":"progress","db":')
        .when(kind == 2, '{"msg":"ok","step":"pre","db":"demo","name":"clean"}')
        .when(kind == 3, '{"msg":"error","step":"post","db":"demo","name":"grant"}')
        .when(kind == 4, '{"msg":"progress","tablesDone":"many"}')
        .otherwise(progress)
    )
    behind = F.element_at(F.array(*[F.lit(t) for t in (" tail", "{}", "] tail", "]", "]{", "}")]), (i / 20 % 6 + 1).cast("int"))
    line = F.when(i % 20 == 19, F.concat(line, behind)).otherwise(line)
    return load(spark, sf_dir, "events").select(
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run"), i.alias("line_no"), line.alias("value")
    )


def pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointer documents read off the events, good and bad."""
    i = F.col("event_id")
    kind = i % 12
    destination = (
        F.when(kind == 0, "http://bucket/key").when(kind == 1, "s3://bucket").when(kind == 2, "s3://u@bucket/key")
        .when(kind == 3, "s3://bucket/key?x=1").when(kind == 4, "s3://bucket/key#frag")
        .otherwise(F.concat(F.lit("s3://bucket/backups/"), i.cast("string")))
    )
    version = F.when(kind.isin(5, 6), F.concat(F.lit(',"schemaVersion":'), (kind - 4).cast("string"))).when(
        kind == 7, ',"schemaVersion":0'
    ).otherwise("")
    published = F.when(i % 24 == 20, ',"publishedAt":"not-a-time"').when(kind.isin(5, 6, 8), F.concat(
        F.lit(',"publishedAt":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z"')
    )).otherwise("")
    behind = F.element_at(F.array(*[F.lit(t) for t in ("] tail", "]", "]{", "}", "{}")]), (i / 24 % 5 + 1).cast("int"))
    name = F.when(kind == 9, "").otherwise(F.concat(F.lit("backup-"), i.cast("string")))
    text = F.concat(
        F.lit('{"name":"'), name, F.lit('","destination":"'), destination, F.lit('"'), version, published,
        F.when(kind == 10, "").otherwise("}"), F.when(i % 24 == 18, " {}").when(i % 24 == 23, behind).otherwise(""),
    )
    return load(spark, sf_dir, "events").select("event_id", text.alias("value"))

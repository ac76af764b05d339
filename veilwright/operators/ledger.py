"""Questions over tables of backups and runs, asked per group and at any size.

A group (a cluster, an output, a schedule) may hold a large share of all rows, so no
operator gathers one: selections are hash aggregates over fixed-width integers with
map-side combine. Their answers, a row per group, are stored, so that Spark broadcasts
them while they are small and splits a large group's rows where they are not; no group's
rows are shuffled for an answer of one row. Top-k cuts are ranked filters that Spark
limits before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

# Backup states that are counted.
STATES = ("Succeeded", "Failed", "Running", "Starting")


#: Tasks that `meet` spreads one group's rows over.
SALTS = 32


def meet(rows: DataFrame, answers: DataFrame, by: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join one answer per group back to the group's rows, spreading each group over `salts` tasks.

    For answers that are neither stored nor small; the selections here store theirs.
    """
    salted_rows = rows.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salts)))
    salted_answers = answers.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted_rows.join(salted_answers, [*by, "__salt"], how).drop("__salt")


def _newest_first(*moments: Column) -> list[Column]:
    """Ascending sort keys that put the newest moment first and unknown ones last."""
    return [F.coalesce(-F.unix_micros(m), F.lit(2**62)) for m in moments]


# --- backups ------------------------------------------------------------------------------
# Columns: name, cluster, state, created_at, completed_at, destination, spec_storage,
# status_storage; `by` names the grouping columns.


def candidate_filter(backups: DataFrame, cluster: str | None = None, storages: list[str] | None = None) -> DataFrame:
    """Backups of a cluster, optionally on given storages (spec first, else status)."""
    found = backups
    if cluster is not None:
        found = found.where(F.col("cluster") == cluster)
    if storages:
        found = found.where(storage_name().isin(storages))
    return found


def storage_name() -> Column:
    return F.when(F.col("spec_storage") != "", F.col("spec_storage")).otherwise(F.col("status_storage"))


def selectable() -> Column:
    """A Succeeded backup outside object storage cannot be selected; other states pass."""
    return (F.col("state") != "Succeeded") | F.col("destination").startswith("s3://")


def state_counts(backups: DataFrame, by: list[str]) -> DataFrame:
    """Backups per state; states outside the four are not counted."""
    counts = [F.count_if(F.col("state") == s).alias(s.lower()) for s in STATES]
    return backups.groupBy(*by).agg(*counts)


def _first_of(rows: DataFrame, by: list[str], lead: Column, then: list[Column], counts: list[Column]) -> DataFrame:
    """Per group: the row with the greatest `lead` (a bigint, NULL for rows that cannot win), ties by `then`, and counts.

    A hash aggregate finds the greatest value. The rows that hold it meet it on group and value together, so a large
    group is no skew, and only they are ranked.
    """
    led = rows.withColumn("__lead", lead)
    top = written(led.groupBy(*by).agg(F.max("__lead").alias("__lead"), *counts), "tops")
    holders = led.where(F.col("__lead").isNotNull()).join(top.select(*by, "__lead"), [*by, "__lead"], "left_semi")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*then))
    winners = holders.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__lead")
    return top.drop("__lead").join(winners, by, "left")


def latest_succeeded(backups: DataFrame, by: list[str]) -> DataFrame:
    """Per group: the newest Succeeded backup (completed, then created, then name) and counts."""
    good = F.col("state") == "Succeeded"
    found = _first_of(
        backups.select(*by, "state", "name", "created_at", "completed_at", "destination"), by,
        F.when(good, F.unix_micros("completed_at")), [*_newest_first(F.col("created_at")), F.col("name")],
        [F.count_if(good).alias("succeeded"), F.count_if(good & F.col("completed_at").isNull()).alias("missing_completion")],
    )
    return found.select(
        *by, F.col("name").alias("selected"), F.col("created_at").alias("selected_created_at"),
        F.col("completed_at").alias("selected_completed_at"), F.col("destination").alias("selected_destination"),
        "succeeded", "missing_completion",
    )


def selection_reason(backups: DataFrame, by: list[str]) -> DataFrame:
    """Why each group's selection stands, given backups created after it."""
    chosen = written(latest_succeeded(backups.where(selectable()), by).where(F.col("selected").isNotNull()), "chosen")
    newer = backups.select(*by, "name", "state", "created_at").join(chosen.select(*by, "selected_created_at"), by).where(
        F.col("created_at") > F.col("selected_created_at")
    )
    busy = F.col("state").isin("Running", "Starting")
    facts = _first_of(
        newer, by, F.when(busy, F.unix_micros("created_at")), [F.col("name")],
        [F.count_if(F.col("state") == "Failed").alias("newer_failed")],
    ).select(*by, "newer_failed", F.col("name").alias("in_progress"))
    failed = F.coalesce("newer_failed", F.lit(0))
    # Reasons and messages, which users' alerts compare.
    reason = (
        F.when(failed > 0, "NewerBackupFailed")
        .when(F.col("in_progress").isNotNull(), "NewerBackupInProgress")
        .otherwise("LatestSucceeded")
    )
    message = (
        F.when(failed > 0, F.concat(failed.cast("string"), F.lit(" newer backups failed; selected successful backup "), "selected"))
        .when(F.col("in_progress").isNotNull(),
              F.concat(F.lit("newer backup "), "in_progress", F.lit(" is in progress; selected successful backup "), "selected"))
        .otherwise(F.concat(F.lit("selected the latest successful backup "), F.col("selected")))
    )
    return chosen.join(facts, by, "left").select(*by, "selected", reason.alias("reason"), message.alias("message"))


def no_candidate_reason(backups: DataFrame, published: DataFrame, by: list[str]) -> DataFrame:
    """Groups without a selection, and why. `published` holds (by..., current) names."""
    chosen = latest_succeeded(backups.where(selectable()), by)
    empty = published.join(chosen, by, "left").where(F.col("selected").isNull())
    # A published name is looked up by (group, name), which no group can skew.
    alive = backups.select(*by, F.col("name").alias("current")).distinct().withColumn("alive", F.lit(True))
    looked = empty.join(alive, [*by, "current"], "left")
    missing = F.coalesce("missing_completion", F.lit(0))
    dangling = F.col("current").isNotNull() & F.col("alive").isNull()
    # Phases, reasons and messages, which users' alerts compare.
    return looked.select(
        *by,
        F.when(dangling, "Dangling").otherwise("NoCandidate").alias("phase"),
        F.when(dangling, "SelectedBackupDeleted").otherwise("NoSucceededBackup").alias("reason"),
        F.when(dangling, "the selected backup was deleted and no replacement is available")
        .when(missing > 0, F.concat(missing.cast("string"), F.lit(" successful backups have no completion timestamp")))
        .otherwise("no successful S3 backup with a completion timestamp is available")
        .alias("message"),
    )


def freshness(selected: DataFrame, now: Column, stale_after_hours: float = 36) -> DataFrame:
    """Adds `fresh`: the backup completed within the limit. No backup is stale."""
    limit = F.lit(int(stale_after_hours * 3600 * 1_000_000))
    due = F.unix_micros("selected_completed_at") + limit
    return selected.withColumn("fresh", F.coalesce(due > F.unix_micros(now), F.lit(False)))


def retention_prune(
    backups: DataFrame, owners: DataFrame, by: list[str], now: Column, keep: int = 2, failed_after_hours: float = 24
) -> DataFrame:
    """Backups to delete. Extra columns: run_uid, has_owner_reference, is_current.

    Succeeded beyond the newest `keep` of its group, or Failed and old enough; never the
    current output, never a backup whose owning run is not settled. Protected backups
    still take up their rank.

    Newest means by completion, then creation, then name. Completions compare only with completions: a group in
    which any succeeded backup lacks one is ordered by creation.
    """
    keep = keep if keep > 0 else 2
    failed_after_hours = failed_after_hours if failed_after_hours > 0 else 24
    group = backups.where(~F.col("has_owner_reference"))
    succeeded = group.where(F.col("state") == "Succeeded")
    lacking = written(succeeded.groupBy(*by).agg(F.max(F.col("completed_at").isNull()).alias("__lacking")), "lacking")
    order = [*_newest_first(F.when(~F.col("__lacking"), F.col("completed_at")), F.col("created_at")), F.col("name")]
    # Narrow rows are ranked, and Spark cuts `row_number <= keep` per task before the shuffle, so a large group stays spread.
    kept = (
        succeeded.select(*by, "name", "completed_at", "created_at").join(lacking, by)
        .withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        .where(F.col("__rank") <= keep)
        .select(*by, "name")
    )
    beyond = succeeded.join(written(kept, "kept"), [*by, "name"], "left_anti")
    age = F.unix_micros(now) - F.unix_micros("created_at")
    old = group.where((F.col("state") == "Failed") & (age >= F.lit(int(failed_after_hours * 3600 * 1_000_000))))
    settled = owners.where("settled").select("run_uid").distinct()
    removable = beyond.unionByName(old).where(~F.col("is_current"))
    return removable.join(settled, "run_uid", "left_semi")


def settled_owner_filter(backups: DataFrame, owners: DataFrame) -> DataFrame:
    """Backups whose owning run is settled."""
    return backups.join(owners.where("settled").select("run_uid").distinct(), "run_uid", "left_semi")


# --- runs ---------------------------------------------------------------------------------
# Columns: name, schedule, phase, settled, created_at, completed_at, and stage endpoints.


def settled() -> Column:
    """A terminal run, not being deleted, whose cleanup outcome is recorded."""
    return (
        F.col("phase").isin("Completed", "Failed")
        & F.col("deleted_at").isNull()
        & (F.coalesce("cleaned_up", F.lit(False)) | F.coalesce("retained", F.lit(False)))
    )


def history_prune(runs: DataFrame, by: list[str], keep_completed: int, keep_failed: int) -> DataFrame:
    """Settled runs beyond the limit of their phase, oldest first by completion (else creation), then name."""
    moment = F.coalesce("completed_at", "created_at")
    over = Window.partitionBy(*by, "phase").orderBy(moment.desc(), F.col("name").desc())
    doomed = []
    for phase, keep in (("Completed", keep_completed), ("Failed", keep_failed)):
        mine = runs.where(F.col("settled") & (F.col("phase") == phase))
        if keep > 0:
            kept = mine.withColumn("__rank", F.row_number().over(over)).where(F.col("__rank") <= keep)
            mine = mine.join(kept.select(*by, "name"), [*by, "name"], "left_anti")
        doomed.append(mine)
    return doomed[0].unionByName(doomed[1])


def run_status_rollup(runs: DataFrame, by: list[str]) -> DataFrame:
    """Per group: active count, newest run (by creation, then the greater name) and its phase, latest success."""
    found = _first_of(
        runs.select(*by, "name", "phase", "settled", "created_at", "completed_at"), by, F.unix_micros("created_at"),
        [F.col("name").desc()],
        [F.count_if(~F.col("settled")).alias("active_count"),
         F.max(F.when(F.col("phase") == "Completed", F.col("completed_at"))).alias("last_success")],
    )
    return found.select(*by, "active_count", F.col("name").alias("last_run"), F.col("phase").alias("last_phase"), "last_success")


def active_runs(runs: DataFrame, by: list[str]) -> DataFrame:
    """Names of active runs, one row each: a schedule's list has no bound, so it stays a table."""
    return runs.where(~F.col("settled")).select(*by, "name")


def phase_distribution(runs: DataFrame, by: list[str]) -> DataFrame:
    return runs.groupBy(*by, "phase").agg(F.count("*").alias("runs"))


STAGES = (
    ("restore", "ready_at", "restored_at"),
    ("anonymize", "anonymize_started_at", "anonymize_completed_at"),
    ("backup", "anonymize_completed_at", "output_completed_at"),
    ("publish", "backed_up_at", "published_at"),
)


def stage_durations(runs: DataFrame, key: list[str]) -> DataFrame:
    """One row per measured stage; a missing or reversed end gives no row."""
    spans = F.array(*[
        F.struct(F.lit(stage).alias("stage"), F.col(start).alias("start"), F.col(end).alias("end"))
        for stage, start, end in STAGES
    ])
    rows = runs.select(*key, F.inline(spans)).where(F.col("end") >= F.col("start"))
    seconds = (F.unix_micros("end") - F.unix_micros("start")) / F.lit(1e6)
    return rows.select(*key, "stage", seconds.alias("seconds"))


def condition_transitions(conditions: DataFrame, key: list[str]) -> DataFrame:
    """Unix second of each condition's last status change; conditions without one are left out."""
    return conditions.where(F.col("changed_at").isNotNull()).select(
        *key, "type", "status", F.unix_seconds("changed_at").alias("changed_at_seconds")
    )


def pointer_max_age(documents: DataFrame, now: Column, max_age_hours: float) -> DataFrame:
    """Adds `accepted` and `warning`: published within the limit and not in the future.

    A version-1 document without a timestamp passes with a warning.
    """
    if max_age_hours <= 0:
        raise ValueError("the age limit must be above zero")
    limit = F.lit(int(max_age_hours * 3600 * 1_000_000))
    published = F.unix_micros("published_at")
    current = F.unix_micros(now)
    inside = (current - published <= limit) & (published <= current)
    legacy = F.col("published_at").isNull() & (F.col("schema_version") == 1)
    return documents.withColumns({
        "accepted": legacy | F.coalesce(inside, F.lit(False)),
        "warning": F.when(legacy, "LegacyPointerAgeUnknown"),
    })


# --- run logs -----------------------------------------------------------------------------
# Columns of `parsed`: run, line_no, and the fields of one log line.


def last_lines(lines: DataFrame, by: list[str], keep: int = 200) -> DataFrame:
    """The last `keep` lines of each log."""
    over = Window.partitionBy(*by).orderBy(F.col("line_no").desc())
    return lines.withColumn("__rank", F.row_number().over(over)).where(F.col("__rank") <= keep).drop("__rank")


def latest_progress(parsed: DataFrame, by: list[str]) -> DataFrame:
    """The last valid progress record of each run."""
    valid = parsed.where(
        (F.col("msg") == "progress")
        & (F.col("tablesDone") >= 0)
        & (F.col("tablesTotal") >= F.col("tablesDone"))
        & (F.col("rowsDone") >= 0)
        & (F.col("stepsDone") >= 0)
    )
    last = _first_of(valid, by, F.col("line_no"), [F.col("rowsDone").desc()], [])
    return last.select(
        *by, "tablesDone", "tablesTotal", "rowsDone", "stepsDone", F.concat_ws(".", "db", "table").alias("currentTable")
    )


def step_outcomes(parsed: DataFrame, by: list[str], keep: int = 8) -> DataFrame:
    """The first `keep` step outcomes of each run."""
    hits = parsed.where(F.col("msg").isin("ok", "error") & F.col("step").isin("pre", "post"))
    over = Window.partitionBy(*by).orderBy("line_no")
    first = hits.withColumn("__rank", F.row_number().over(over)).where(F.col("__rank") <= keep)
    outcome = F.concat(F.lit("runner "), F.col("step"), F.lit(" step reported "), F.col("msg"))
    return first.select(*by, "line_no", outcome.alias("outcome"))

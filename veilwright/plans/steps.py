"""SQL steps that run once per run and database, in declared order."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import AnonymizeError, PolicyError, UncertainStep
from .progress import Manifest, ProgressKey


def execute(spark: SparkSession, body: str) -> None:
    """Run a body whole: one statement, or a `BEGIN ... END` script. It is never split on `;`."""
    if not body.strip():
        raise PolicyError("an SQL step has no text")
    # Writing to the no-op sink runs a query to its end without bringing rows to the driver.
    spark.sql(body).write.format("noop").mode("overwrite").save()


def run_step(spark: SparkSession, body: str, manifest: Manifest, key: ProgressKey) -> bool:
    """Run a step unless it is done. An intent without an end is refused, and so is a step that another driver has taken."""
    if key.kind != "step":
        raise PolicyError("a step needs a progress key of kind step")
    states = [row["done"] for row in manifest.entries(key)]
    if True in states:
        return False
    if states:
        raise UncertainStep()
    if not manifest.claim(key):
        manifest.refresh(key)
        if any(row["done"] for row in manifest.entries(key)):
            return False
        raise UncertainStep()
    manifest.append(key, done=False)
    try:
        execute(spark, body)
        manifest.append(key, done=True)
    except Exception as error:
        raise UncertainStep() from error
    return True


def resolve_step(manifest: Manifest, key: ProgressKey) -> None:
    """An operator's word that an uncertain step took effect."""
    manifest.append(key, done=True)


def run_steps(
    spark: SparkSession,
    phase: str,
    refs: list[dict],
    definitions: dict[str, dict],
    bodies: dict[str, str],
    manifest: Manifest,
    identity: tuple[str, str, str],
) -> int:
    """Run a database's pre or post steps; return how many are done."""
    run_uid, database, policy_hash = identity
    finished = 0
    for position, ref in enumerate(refs):
        name = ref["name"]
        try:
            key = ProgressKey(run_uid, "step", database, f"{phase}:{position}:{name}", policy_hash)
            run_step(spark, bodies[name], manifest, key)
        except UncertainStep:
            raise
        except AnonymizeError:
            if not definitions[name].get("continueOnError"):
                raise
            continue
        finished += 1
    return finished

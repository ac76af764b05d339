"""One run: policy in, rewritten tables and a report out."""

from __future__ import annotations

import datetime as dt
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from decimal import Decimal
from functools import cache
from threading import Lock
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PolicyError, classify
from ..functions.digest import DEFAULT_NAMESPACE, Keyring, fresh_seed
from ..operators.unique import resolve_unique, transform_unique
from ..sources.dataset import Dataset, truncated
from .policy import canonical_json, decode
from .preflight import ExecutionPlan, PreflightOptions, TablePlan, preflight
from .progress import Manifest, ProgressKey
from .record import freeze
from .report import Report
from .resume import PAGES, Checksum, Chunk, committed, from_files, key_chunks, merged_checksum, packed_chunks, prove_chunks, run_chunks
from .steps import run_steps


@dataclass
class RunOptions:
    run_uid: str
    seed: bytes | None  # None: a seed of its own for this run, which then cannot be resumed
    reference_time: dt.datetime | dt.date
    output: str
    workers: int = 4
    page_size: int | None = None
    chunks: int | None = None  # None: as many as `pages` pages of the table's page size make
    chunk_by: str | None = None  # "files" or "key"; None: files, but the key where a number of chunks is asked for
    pages: int = PAGES
    dry_run: bool = False
    steps_dir: str | None = None
    constants_dir: str | None = None
    allow_keyless: bool = False
    verify_keys: bool = True
    against_originals: bool = True
    checksums: bool = False  # record the checksum of what each chunk writes
    namespace: str = DEFAULT_NAMESPACE
    progress: Callable[[dict], None] | None = None


class Run:
    """Runs a policy over a dataset. Results land under `output/<database>/<table>`."""

    def __init__(self, spark: SparkSession, policy: bytes | str | dict, dataset: Dataset, options: RunOptions):
        self.spark, self.dataset, self.options = spark, dataset, options
        self._policy = policy
        self._lock = Lock()
        self.report = Report()
        self.plan: ExecutionPlan | None = None

    def execute(self) -> Report:
        started = time.monotonic()
        try:
            self._execute()
        except Exception as error:
            self.report.result = "error"
            self.report.failure_class, self.report.message = classify(error)
            self.error = error
        self.report.durationSeconds = time.monotonic() - started
        return self.report

    def _execute(self) -> None:
        o = self.options
        if not o.run_uid or len(o.run_uid) > 128 or o.reference_time is None:
            raise PolicyError("a run needs a uid of at most 128 characters and a reference time")
        if o.chunk_by not in (None, "files", "key") or o.pages < 1 or (o.chunks is not None and o.chunks < 1):
            raise PolicyError("chunks are made by files or by key, of one page or more")
        if not 1 <= o.workers <= 32 or not 1 <= (o.page_size or 5000) <= 50000:
            raise PolicyError("workers (1..32) or page size (1..50000) is out of range")
        spec, policy_hash = decode(self._policy)
        self.report.policyHash = policy_hash
        mode = (spec.get("determinism") or {}).get("mode") or "PerRun"
        if o.seed is None and mode == "Fixed":
            raise PolicyError("Fixed determinism requires its seed")
        seed = fresh_seed() if o.seed is None else o.seed
        try:
            self.keyring = Keyring.derive(seed, policy_hash, o.reference_time, o.namespace)
        except ValueError:
            raise PolicyError("the seed is too short or the reference time unusable") from None
        checks = PreflightOptions(
            self.keyring.reference_date, o.steps_dir, o.constants_dir, o.page_size, o.allow_keyless, o.verify_keys
        )
        self.plan = preflight(spec, self.dataset, checks)
        self.report.tablesTotal = self.plan.tables_total
        if o.dry_run:
            self.report.message = "all checks passed; nothing was written"
            return
        self.manifest = Manifest(self.spark, f"{o.output}/_progress")
        freeze(self.spark, f"{o.output}/_run", o.run_uid, canonical_json(spec), policy_hash, self.keyring)
        definitions = {step["name"]: step for step in spec.get("steps") or []}
        for database in self.plan.databases:
            identity = (o.run_uid, database.name, policy_hash)
            self.dataset.enter(self.spark, database.name)
            for phase in ("pre", "post"):
                if phase == "post":
                    self._tables(database.tables)
                self.report.stepsDone += run_steps(
                    self.spark, phase, database.policy.get(phase) or [], definitions, self.plan.steps,
                    self.manifest, identity,
                )
            self.dataset.leave(self.spark, database.name)

    def _tables(self, tables: list[TablePlan]) -> None:
        # Each table is one Spark job chain; the threads only wait for them.
        with ThreadPoolExecutor(max_workers=self.options.workers) as pool:
            for future in [pool.submit(self._table, table) for table in tables]:
                future.result()

    def _key(self, plan: TablePlan) -> ProgressKey:
        return ProgressKey(self.options.run_uid, "table", plan.database, plan.table, self.report.policyHash)

    def _table(self, plan: TablePlan) -> None:
        o, frame = self.options, self.dataset.table(plan.database, plan.table)
        output, rows = f"{o.output}/{plan.database}/{plan.table}", 0
        if plan.action == "Truncate":
            if not any(row["done"] for row in self.manifest.entries(self._key(plan))):
                fmt, partitions = self._layout(plan) or ("parquet", ())
                truncated(frame).write.mode("overwrite").format(fmt).partitionBy(*partitions).save(f"{output}/chunk=0")
                self.manifest.append(self._key(plan), path=f"{output}/chunk=0", rows=0, checksum=Decimal(0))
        else:
            transform = plan.transform
            # Found when the first open chunk asks, so a finished table costs no second resolution.
            retries = cache(lambda: resolve_unique(frame, transform, self.keyring, o.against_originals))
            key = tuple(column.name for column in transform.primary_key)
            rows = run_chunks(
                frame,
                lambda part: transform_unique(part, transform, self.keyring, retries(), mark=True),
                lambda: self._chunks(plan, frame, key, f"{output}/_plan"),
                self.manifest, self._key(plan), output, key, self._layout(plan), o.checksums,
            )
        with self._lock:
            self.report.tablesDone += 1
            self.report.rowsDone += rows
            if o.progress:
                r = self.report
                o.progress({
                    "msg": "progress", "db": plan.database, "table": plan.table, "tablesDone": r.tablesDone,
                    "tablesTotal": r.tablesTotal, "rowsDone": r.rowsDone, "stepsDone": r.stepsDone,
                })

    def _layout(self, plan: TablePlan) -> tuple:
        return self.dataset.layout(plan.database, plan.table)

    def _chunks(self, plan: TablePlan, frame: DataFrame, key: tuple[str, ...], place: str) -> list[Chunk]:
        """Packs of files where rows come from files, else cuts by key; of `pages` pages each, or `chunks` of them."""
        o, size = self.options, plan.page_size * self.options.pages
        by_key = o.chunk_by == "key" or (o.chunk_by is None and o.chunks is not None)
        if from_files(frame) and not (by_key and key):
            return packed_chunks(frame, place, None if o.chunks else size, o.chunks)
        if not key:
            return [Chunk(0)]
        return key_chunks(frame, key, o.chunks or max(1, -(-frame.count() // size)))

    def _plan(self, database: str, table: str) -> TablePlan:
        return next(t for d in self.plan.databases for t in d.tables if (d.name, t.table) == (database, table))

    def checksum(self, database: str, table: str) -> Checksum:
        """Rows and checksum of what a run with `checksums` wrote, from its commits alone."""
        return merged_checksum(self.manifest, self._key(self._plan(database, table)))

    def prove_source(self, database: str, table: str, label: str) -> Checksum:
        """Rows and checksum of a source table, chunk by chunk; another driver with this label goes on where one was lost.

        Proofs of one table that differ are of different rows: take one before a dry run, and one after it.
        """
        o, plan, frame = self.options, self._plan(database, table), self.dataset.table(database, table)
        manifest = Manifest(self.spark, f"{o.output}/_progress")
        proof = ProgressKey(f"{o.run_uid}/{label}", "proof", database, table, self.report.policyHash)
        key = tuple(column.name for column in plan.transform.primary_key) if plan.transform else ()
        prove_chunks(frame, lambda: self._chunks(plan, frame, key, f"{o.output}/_proofs/{label}/{database}/{table}"), manifest, proof, key)
        return merged_checksum(manifest, proof)

    def result(self, database: str, table: str) -> DataFrame:
        """Committed rows of one table."""
        plan = self._plan(database, table)
        return committed(self.manifest, self._key(plan), self._layout(plan), self.dataset.table(database, table).schema)


def run_totals(manifest: Manifest, run_uid: str) -> DataFrame:
    """Per table and over the run: committed chunks and rows; steps done."""
    mine = manifest.rows().where((F.col("run_uid") == run_uid) & F.col("done"))
    # Two drivers may both commit a chunk, with the same rows.
    once = mine.groupBy("kind", "db", "name", "chunk").agg(F.max("rows_done").alias("rows_done"))
    return once.groupBy("kind", "db", "name").agg(
        F.count("*").alias("units_done"), F.sum("rows_done").alias("rows_done")
    )

"""Durable progress: which chunks and steps of a run are committed.

Rows are appended to a parquet table next to the output. A chunk counts only once its row
is there, so output that a lost run left behind is never read.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import PolicyError

SCHEMA = (
    "run_uid string, kind string, db string, name string, chunk int, rule string, parts int, lower string, upper string, "
    "rows_done bigint, done boolean, policy_hash string, path string, updated_at timestamp, rows bigint, checksum decimal(38,0)"
)


@dataclass(frozen=True)
class ProgressKey:
    run_uid: str
    kind: str
    db: str
    name: str
    policy_hash: str

    def __post_init__(self):
        limits = ((self.run_uid, 128), (self.db, 64), (self.name, 128), (self.policy_hash, 80))
        if any(not text or len(text) > size for text, size in limits) or self.kind not in ("step", "table", "proof"):
            raise PolicyError("a progress entry needs a run, kind, database, name and policy hash of bounded length")


class Manifest:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self._path = spark, path.rstrip("/")
        self._known: dict[str, list[Row]] = {}

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def rows(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self._path)

    def entries(self, key: ProgressKey) -> list[Row]:
        """Rows of one table or step: at most two per chunk. A different policy hash is refused.

        A run's rows are read once; what this object appends is remembered.
        """
        if key.run_uid not in self._known:
            self._known[key.run_uid] = self.rows().where(F.col("run_uid") == key.run_uid).collect()
        mine = [row for row in self._known[key.run_uid] if (row["kind"], row["db"], row["name"]) == (key.kind, key.db, key.name)]
        if any(row["policy_hash"] != key.policy_hash for row in mine):
            raise PolicyError("recorded progress belongs to another policy hash")
        return mine

    def refresh(self, key: ProgressKey) -> None:
        """Forget what is remembered of a run: another driver may have recorded more."""
        self._known.pop(key.run_uid, None)

    def claim(self, key: ProgressKey, unit: str = "") -> bool:
        """Take a unit of work: True for the one who makes its file, which is made only if it is not there."""
        identity = "\x1f".join((key.run_uid, key.kind, key.db, key.name, key.policy_hash, unit))
        folder = f"{self._path}/_claims"  # no reader looks into it
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{hashlib.sha256(identity.encode()).hexdigest()}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.mkdirs(path.getParent())
        if files.getScheme() == "file":  # where Hadoop looks first and creates then
            return self.spark._jvm.java.io.File(path.toUri().getPath()).createNewFile()
        try:
            files.create(path, False).close()
        except Py4JJavaError as error:
            if files.exists(path):
                return False
            raise error
        return True

    def append(self, key: ProgressKey, **values) -> None:
        self.append_all(key, [values])

    def append_all(self, key: ProgressKey, entries: list[dict]) -> None:
        """Record entries together. Each call owns a folder, so tables may commit at the same time."""
        now = dt.datetime.now(dt.timezone.utc)
        rows = []
        for entry in entries:
            row = {
                "run_uid": key.run_uid, "kind": key.kind, "db": key.db, "name": key.name, "chunk": 0, "rule": None, "parts": None,
                "lower": None, "upper": None, "rows_done": 0, "done": True, "policy_hash": key.policy_hash, "path": None,
                "updated_at": now, "rows": None, "checksum": None, **entry,
            }
            if row["rows_done"] < 0:
                raise PolicyError("a progress entry cannot count fewer than zero rows")
            rows.append(tuple(row.values()))
        frame = self.spark.createDataFrame(rows, SCHEMA).coalesce(1)
        frame.write.parquet(f"{self._path}/entry-{uuid.uuid4().hex}")
        if key.run_uid in self._known:
            names = frame.columns
            self._known[key.run_uid] = [*self._known[key.run_uid], *(Row(**dict(zip(names, row))) for row in rows)]

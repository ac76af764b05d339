"""What a run was started with, frozen before its first write."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import PolicyError
from ..functions.digest import Keyring

SCHEMA = "run_uid string, policy string, policy_hash string, key_id string, reference_date date"


def key_id(keyring: Keyring) -> str:
    """Names the run's key without giving it away."""
    return hashlib.sha256(b"key-id/" + keyring.key).hexdigest()[:16]


def freeze(spark: SparkSession, path: str, run_uid: str, policy: str, policy_hash: str, keyring: Keyring) -> None:
    """Record the run's inputs, or check that a resumed run still has the same ones."""
    row = (run_uid, policy, policy_hash, key_id(keyring), keyring.reference_date)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        frozen = spark.read.schema(SCHEMA).parquet(path).where(F.col("run_uid") == run_uid).head(1)
        if frozen:
            if frozen[0]["policy_hash"] != policy_hash:
                raise PolicyError("recorded progress belongs to another policy hash")
            if tuple(frozen[0]) != row:
                raise PolicyError("seed or reference date differs from the recorded run")
            return
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(path)

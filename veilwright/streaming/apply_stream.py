"""The same rules on a stream: the compiled columns hold no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..errors import PolicyError
from ..functions.digest import Keyring
from ..operators.apply import TableTransform, transform
from ..plans.progress import Manifest, ProgressKey
from ..plans.resume import write_checked


def apply_policy_stream(stream: DataFrame, plan: TableTransform, keyring: Keyring) -> DataFrame:
    """Rewrite a streaming table. UNIQUE resolution needs the whole table, so it is refused."""
    _streamable(stream, plan)
    return transform(stream, plan, keyring)


def _streamable(stream: DataFrame, plan: TableTransform) -> None:
    if not stream.isStreaming:
        raise PolicyError("not a streaming table")
    if set(name for index in plan.unique for name in index) & {info.name for info in plan.columns}:
        raise PolicyError("unique resolution is not available on streams")
    plan.check()


def start_to_files(stream: DataFrame, output: str, checkpoint: str, available_now: bool = True) -> DataStreamWriter:
    """A writer that commits each micro-batch once and resumes from its checkpoint."""
    writer = stream.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if available_now else writer


def start_checked(
    stream: DataFrame, plan: TableTransform, keyring: Keyring, manifest: Manifest, key: ProgressKey, output: str, checkpoint: str,
    available_now: bool = True,
) -> DataStreamWriter:
    """A writer whose micro-batches are chunks of a run: counted, checked and committed like a table's.

    A value that does not fit its column stops the query before its batch is committed. The batch's number is the chunk's:
    a batch that the stream repeats after a loss is committed once. `committed(manifest, key)` reads what is there.
    """
    _streamable(stream, plan)

    def commit(batch: DataFrame, number: int) -> None:
        if not any(row["done"] and row["chunk"] == number for row in manifest.entries(key)):
            path = f"{output}/chunk={number}"
            rows = write_checked(transform(batch, plan, keyring, mark=True), path)
            manifest.append(key, chunk=number, rows_done=rows, path=path)

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if available_now else writer

"""Quality classifier by compression: which of two dictionaries, good or bad text's, suits a document better?

Two zstandard dictionaries are trained on a bounded sample of labelled documents. Every whole text is compressed with
both, in blocks of `BLOCK` bytes so that a long text does not outgrow the dictionaries, and the difference of the two
sizes divided by their sum becomes a probability through a logistic curve fitted on labelled rows that trained no
dictionary.

Nulls and odd cases: null and empty texts have difference 0 and get the curve's value there. A null doc_id is scored
and counts as held out. Without labels of both kinds the score is the share of label 1 (0.5 without any label). Repeated
rows are scored one by one; an empty table gives an empty result; further columns are ignored. Texts of any length are
compressed whole, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder, sample

MODULUS, HELD_OUT = 5, 0
#: Labelled rows that the fit may use: this bounds the one training task and the rows the driver gets.
SAMPLE = 12_000
#: Bytes of one compressed block, and of one dictionary.
BLOCK, DICTIONARY = 2048, 64 * 1024
LEVEL = 1


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    intercept: float
    slope: float

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * difference, -30, 30)))


class Compressors:
    """Both dictionaries, digested once per task."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        import zstandard

        self._pair = []
        for content in (good, bad):
            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=LEVEL)
            self._pair.append(zstandard.ZstdCompressor(
                dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, text: bytes) -> float:
        """(size with bad - size with good) / (sum of both): positive for text like the good one."""
        good, bad = self._pair
        a = b = 0
        for at in range(0, len(text), BLOCK):
            block = text[at:at + BLOCK]
            a += len(good.compress(block))
            b += len(bad.compress(block))
        return (b - a) / (a + b) if a + b else 0.0


def train_dictionaries(texts: list[bytes], labels: list[int]) -> tuple[bytes, bytes]:
    import zstandard

    out = []
    for label in (1, 0):
        # All blocks of all texts.
        blocks = [t[at:at + BLOCK] for t, y in zip(texts, labels, strict=True) if y == label for at in range(0, len(t), BLOCK)]
        try:
            content = zstandard.train_dictionary(DICTIONARY, blocks, level=LEVEL, k=512, d=8).as_bytes()
        except zstandard.ZstdError:  # too few samples for a trained one: their own bytes serve
            content = b"".join(blocks)[-DICTIONARY:]
        out.append(content)
    return out[0], out[1]


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Dictionaries from one half of the sample in one task, the curve from the other half's differences."""
    picked = sample(docs, labels, "quality", MODULUS, HELD_OUT, most).withColumn("half", F.pmod(F.hash("pick"), F.lit(2)))

    def train(table: pa.Table) -> pa.Table:
        order = table.sort_by([("pick", "ascending"), ("doc_id", "ascending")])
        good, bad = train_dictionaries(order["text"].to_pylist(), order["y"].to_pylist())
        return pa.table({"good": pa.array([good], pa.binary()), "bad": pa.array([bad], pa.binary())})

    trained = picked.where("half = 0").groupBy("half").applyInArrow(train, "good binary, bad binary").collect()
    if not trained:
        return Model(b"", b"", 0.0, 0.0)
    good, bad = bytes(trained[0]["good"]), bytes(trained[0]["bad"])
    rows = with_difference(picked.where("half = 1"), good, bad, ("y",)).collect()
    return Model(good, bad, *logistic(np.array([r["difference"] for r in rows]), np.array([r["y"] for r in rows])))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope by Newton's method; a slope of 0 where only one label is known. The slope is never negative."""
    if len(y) == 0:
        return 0.0, 0.0
    share = min(0.999, max(0.001, float(np.mean(y))))
    if share in (0.001, 0.999) or float(np.std(x)) == 0:
        return math.log(share / (1 - share)), 0.0
    scale = float(np.std(x))
    design, w = np.stack([np.ones(len(x)), x / scale], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(2),
                               design.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -2, 2)
        if float(np.abs(step).max()) < 1e-9:
            break
    return (float(w[0]), float(w[1]) / scale) if w[1] > 0 else (math.log(share / (1 - share)), 0.0)


def with_difference(df: DataFrame, good: bytes, bad: bytes, passed: tuple[str, ...]) -> DataFrame:
    """The `passed` columns and `difference`, of rows with a binary `text`."""
    kept = df.select(*passed, "text")
    schema = kept.select(*passed, F.lit(0.0).alias("difference")).schema

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Compressors(good, bad)
        for batch in batches:
            found = [both.difference(t.as_py() or b"") for t in batch.column(len(passed))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(passed)], pa.array(found, pa.float64())],
                                             names=[*passed, "difference"])

    return kept.mapInArrow(compress, schema)


def score(docs: DataFrame, model: Model, passed: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `passed` columns, difference and score (0 to 1; higher: label 1 likelier) of every row."""
    texts = docs.select(*[F.col(f"`{c}`") for c in passed], F.col("text").cast("binary").alias("text"))
    odds = F.lit(model.intercept) + F.lit(model.slope) * F.col("difference")
    return with_difference(texts, model.good, model.bad, passed).withColumn("score", 1 / (1 + F.exp(-odds)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` whose score reaches the threshold, with their own columns.

    A row goes to Python once, as a whole, and only kept rows come back.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    place = docs.columns.index("text")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Compressors(model.good, model.bad)
        for batch in batches:
            texts = batch.column(0).field(place).cast(pa.binary())
            found = np.array([both.difference(t.as_py() or b"") for t in texts])
            yield batch.filter(pa.array(model.score(found) >= threshold))

    return rows.mapInArrow(over, rows.schema).select("_row.*")

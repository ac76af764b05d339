"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and non-ASCII characters, ASCII lower-cased. Features are single words, pairs of
neighbours and pairs with one or two words between them, hashed into 2 ** `BITS` slots; each counts once per document.
Training runs in one task over a bounded sample of labelled documents, with a learning rate per coordinate; the L1 term
leaves few weights, whose table has at most 2 ** `BITS` entries whatever the corpus' size, so that it may be broadcast.

Nulls and odd cases: null and empty texts have no features and get the intercept's probability. A null doc_id is scored
and does not count as held out. Without labels the score is 0.5. Repeated rows are scored one by one; an empty table
gives an empty result; further columns are ignored. Texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import ByteHash, bounded, mix64, word_bounds
from .labelled import remainder, sample

MODULUS, HELD_OUT = 4, 2
#: Labelled rows that the fit may use: this bounds the one training task.
SAMPLE = 16_000
BITS = 20
#: Distances of the two words of a pair: neighbours, and skip-grams over one and two words.
GAPS = (1, 2, 3)
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 8.0, 1.0, 4
#: Bytes of text that a task hashes at a time (a longer text stands alone).
CHUNK = 1 << 20

_PLAIN = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256)).lower()


@dataclass(frozen=True)
class Model:
    """Feature slots with a weight, their weights, and the intercept."""

    slots: np.ndarray
    weights: np.ndarray
    intercept: float


def features(texts: list[bytes], hasher: ByteHash) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of every feature occurrence. No pair reaches over the end of a text."""
    plain = [t.translate(_PLAIN) for t in texts]
    data = b" ".join(plain)
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = hasher.slices(data, starts, ends)
    text_ends = np.cumsum([len(p) + 1 for p in plain])
    owner = np.searchsorted(text_ends, starts, side="right")
    owners, hashes = [owner], [words]
    for gap in GAPS:
        if len(words) > gap:
            together = owner[gap:] == owner[:-gap]
            owners.append(owner[gap:][together])
            hashes.append((words[:-gap] * np.uint64(2 * gap + 1) + mix64(words[gap:] + np.uint64(gap)))[together])
    slots = mix64(np.concatenate(hashes)) >> np.uint64(64 - BITS)
    return np.concatenate(owners), slots.astype(np.int64)


def train(texts: list[bytes], labels: list[int]) -> Model:
    """FTRL-proximal over the documents in the given order, several times."""
    hasher, examples = ByteHash(), []
    for part in bounded(texts, CHUNK):
        owner, slot = features([texts[i] for i in part], hasher)
        keys = np.unique((owner << BITS) | slot)
        cuts = np.searchsorted(keys >> BITS, np.arange(len(part) + 1))
        examples += [(keys[cuts[k]:cuts[k + 1]] & ((1 << BITS) - 1)).astype(np.int32) for k in range(len(part))]
    bias = 1 << BITS  # the intercept: a coordinate that every example has and L1 leaves alone
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)
    for _ in range(EPOCHS):
        for x, y in zip(examples, labels, strict=True):
            x = np.append(x, bias)
            zx, nx = z[x], n[x]
            w = _weights(zx, nx)
            w[-1] = -zx[-1] / ((BETA + np.sqrt(nx[-1])) / ALPHA)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            rate = (np.sqrt(nx + gradient * gradient) - np.sqrt(nx)) / ALPHA
            z[x] = zx + gradient - rate * w
            n[x] = nx + gradient * gradient
    w = _weights(z[:-1], n[:-1])
    slots = np.flatnonzero(w)
    return Model(slots, w[slots], float(-z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA)))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    picked = sample(docs, labels, "toxic", MODULUS, HELD_OUT, most)

    def one_task(table: pa.Table) -> pa.Table:
        order = table.sort_by([("pick", "ascending"), ("doc_id", "ascending")])
        m = train(order["text"].to_pylist(), order["y"].to_pylist())
        return pa.table({"slots": [m.slots.astype("<i8").tobytes()], "weights": [m.weights.astype("<f8").tobytes()],
                         "intercept": [m.intercept]})

    rows = picked.groupBy(F.lit(0).alias("all")).applyInArrow(
        one_task, "slots binary, weights binary, intercept double").collect()
    if not rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    return Model(np.frombuffer(bytes(rows[0]["slots"]), "<i8"), np.frombuffer(bytes(rows[0]["weights"]), "<f8"),
                 rows[0]["intercept"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1; higher: label 1 likelier) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hasher = shared.value, ByteHash()
        table = np.zeros(1 << BITS, np.float32)
        table[m.slots] = m.weights
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1)]
            odds = np.full(len(texts), m.intercept)
            for part in bounded(texts, CHUNK):
                owner, slot = features([texts[i] for i in part], hasher)
                weighty = np.flatnonzero(table[slot])
                keys = np.unique((owner[weighty] << BITS) | slot[weighty])
                np.add.at(odds, part.start + (keys >> BITS), table[keys & ((1 << BITS) - 1)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))), pa.float64())], names=["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(over, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))

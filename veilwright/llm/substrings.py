"""Substring dedup: removes words of long passages that an earlier document has too.

A window is `WINDOW` consecutive words. A word goes if some window over it also starts in a document with a smaller
doc_id, judged on the input. Three things keep the work in proportion to the text and every task bounded:

* Each window is led by its smallest hash of `GRAM` words (its anchor), so equal windows have equal anchors, and
  neighbouring windows mostly share one. Runs of windows with one anchor are the unit of work. Runs whose anchor occurs
  in one document only hold nothing that repeats, and equal runs are collapsed into one with its smallest doc_id.
* What remains is dealt out by anchor and cut into shards of bounded size. A shard is an FM-index over its runs; all runs
  are streamed through it by backward search over a wavelet matrix, and the matching windows' smallest document is read
  off the interval that the search ends with. Each run finds at least itself, so no match ever breaks off.
* An anchor with over `CROWD` different runs would make a shard too large. There the windows themselves are grouped by two
  64-bit hashes: equal ones meet after a map-side minimum, so the crowd spreads over all tasks.

Runs and windows stand for their words by two 64-bit hashes. Each is made of its own hash of every word (two seeds, nothing
linear), mixed with the word's place, so different words or orders share both by chance only, however they are patterned.

Nulls and odd cases: a null or empty text has no words. A row with a null doc_id keeps all its words and is nobody's
earlier document. Rows with the same doc_id are never earlier than each other; those with the same text too are judged
once, and each of them gets that verdict. An empty table gives an empty result;
further columns of the input come back untouched, whatever their names but for a leading `_sub_`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.sources.scratch import written

from .batches import WordHash, bounded, mix64, ragged_arange, word_bounds
from .fmindex import matching_windows

WINDOW, GRAM = 50, 10
#: Windows of one run: its verdict is one bit each of a long.
RUN = 64
#: Words that a shard gathers before it is indexed; different runs of one anchor up to which it is indexed as a whole.
SHARD, CROWD = 600_000, 3_000
#: Bytes of text treated at a time (a longer text stands alone).
CHUNK = 1 << 20

_C1, _C2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
_RUNS = "doc_id long, th long, start int, n int, anchor long, k1 long, k2 long"


def _rolling(words: np.ndarray, base: np.uint64, length: int) -> np.ndarray:
    """Hashes of all stretches of `length` word hashes, to choose anchors by: equal stretches have equal ones."""
    out = np.zeros(len(words) - length + 1, np.uint64)
    for k in range(length):
        out = out * base + words[k:k + len(out)]
    return mix64(out)


def _content(words: np.ndarray, begin: np.ndarray, size: np.ndarray, step: np.uint64) -> np.ndarray:
    """A hash of the words of each stretch: every word's hash mixed with its place in the stretch."""
    out = np.zeros(len(begin), np.uint64)
    for low in range(0, len(begin), 1_000):
        part = slice(low, low + 1_000)
        place = ragged_arange(size[part])
        mixed = mix64(words[np.repeat(begin[part], size[part]) + place] + (place + 1).astype(np.uint64) * step)
        out[part] = np.add.reduceat(mixed, np.cumsum(size[part]) - size[part])
    return mix64(out + size.astype(np.uint64))


def _sliding_min(values: np.ndarray, length: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= length:
        values, reach = np.minimum(values[:-reach], values[reach:]), 2 * reach
    rest = length - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def runs_of(texts: list[bytes], hashers: tuple[WordHash, WordHash], window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of neighbouring windows with one anchor: text number, first word, number of windows, anchor, content keys."""
    data = b" ".join(texts)
    starts, ends = word_bounds(data)
    empty = {k: np.zeros(0, np.int64) for k in ("text", "start", "n", "anchor", "k1", "k2")}
    if len(starts) < window:
        return empty
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    first_word = np.searchsorted(owner, np.arange(len(texts)))
    words, others = (h.slices(data, starts, ends) for h in hashers)
    anchor = _sliding_min(_rolling(words, _C1, gram), window - gram + 1)
    valid = np.flatnonzero(owner[:len(anchor)] == owner[window - 1:])
    if not len(valid):
        return empty
    led = anchor[valid]
    fresh = np.ones(len(valid), bool)
    fresh[1:] = (led[1:] != led[:-1]) | (valid[1:] != valid[:-1] + 1)
    heads = np.flatnonzero(fresh)
    place = np.arange(len(valid)) - np.repeat(heads, np.diff(np.append(heads, len(valid))))
    heads = np.flatnonzero(place % RUN == 0)
    n = np.diff(np.append(heads, len(valid)))
    begin = valid[heads]
    size = n + window - 1
    out = {"text": owner[begin], "start": begin - first_word[owner[begin]], "n": n, "anchor": led[heads].view(np.int64)}
    out["k1"] = _content(words, begin, size, _C1).view(np.int64)
    out["k2"] = _content(others, begin, size, _C2).view(np.int64)
    return out


def window_keys(passages: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of the passages (words joined by spaces): the passage's number, its place there, and two hashes."""
    data = b" ".join(passages)
    bounds = word_bounds(data)
    sizes = np.array([p.count(b" ") + 1 for p in passages], np.int64)
    counts = np.maximum(sizes - window + 1, 0)
    owner, place = np.repeat(np.arange(len(passages)), counts), ragged_arange(counts)
    begin = (np.cumsum(sizes) - sizes)[owner] + place
    length = np.full(len(begin), window, np.int64)
    keys = [_content(hasher.slices(data, *bounds), begin, length, step).view(np.int64)
            for hasher, step in zip(_hashers(), (_C1, _C2), strict=True)]
    return owner, place, keys[0], keys[1]


def _hashers() -> tuple[WordHash, WordHash]:
    return WordHash(1), WordHash(2)


def _identified(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _find_runs(docs: DataFrame, window: int) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = _hashers()
        for batch in batches:
            ids, th = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            texts = [t.as_py() or b"" for t in batch.column(2)]
            for part in bounded(texts, CHUNK):
                r = runs_of([texts[i] for i in part], hashers, window)
                at = r["text"] + part.start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at], pa.int64()), pa.array(th[at], pa.int64()), pa.array(r["start"], pa.int32()),
                     pa.array(r["n"], pa.int32()), *[pa.array(r[k], pa.int64()) for k in ("anchor", "k1", "k2")]],
                    names=["doc_id", "th", "start", "n", "anchor", "k1", "k2"])

    return _identified(docs).where("doc_id is not null and text is not null").mapInArrow(over, _RUNS)


def _gather(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Shards of a stream that is sorted by anchor: closed at an anchor's end, once large enough."""
    rows: list[tuple[int, int, int, bytes]] = []
    size, last = 0, None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(5)]
        for anchor, k1, k2, first, passage in zip(*columns, strict=True):
            if size >= SHARD and anchor != last:
                yield _search(rows, window)
                rows, size = [], 0
            rows.append((k1, k2, first, passage))
            size, last = size + passage.count(b" ") + 2, anchor
    if rows:
        yield _search(rows, window)


def _search(rows: list[tuple[int, int, int, bytes]], window: int) -> pa.RecordBatch:
    """One shard: per run, a bit for every window that a smaller document than the run's own first one holds."""
    symbols: dict[bytes, int] = {}
    passages = [np.array([symbols.setdefault(w, len(symbols) + 1) for w in r[3].split(b" ")], np.int64) for r in rows]
    firsts = np.array([r[2] for r in rows], np.int64)
    found = matching_windows(passages, firsts, len(symbols) + 1, window)
    masks = [_mask(f < first) for f, first in zip(found, firsts, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array(firsts), pa.array(masks, pa.int64())],
        names=["k1", "k2", "first", "mask"])


def _mask(earlier: np.ndarray) -> int:
    bits = np.zeros(64, np.uint8)
    bits[:len(earlier)] = earlier
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def _passages(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    """(anchor, k1, k2, first, passage) of the runs in `jobs`: their words, joined by spaces, from their first document."""
    per_text = jobs.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "size", "anchor", "k1", "k2")).alias("jobs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = text.as_py().split()
                rows += [(j["anchor"], j["k1"], j["k2"], doc_id, b" ".join(words[j["start"]:j["start"] + j["size"]])) for j in own]
            kinds = [pa.int64()] * 4 + [pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             names=["anchor", "k1", "k2", "first", "passage"])

    # Repeated rows give each passage once; they are dropped before the shuffle as well as after it.
    once = _identified(docs).where("doc_id is not null and text is not null").dropDuplicates(["doc_id", "th"])
    joined = once.join(per_text, ["doc_id", "th"]).select("doc_id", "text", "jobs")
    return joined.mapInArrow(cut, "anchor long, k1 long, k2 long, first long, passage binary")


def _crowded_masks(passages: DataFrame, window: int) -> DataFrame:
    """The verdicts of runs under crowded anchors, by grouping their windows."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, first = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            values = batch.column(4).to_pylist()
            for part in bounded(values, CHUNK):
                owner, place, w1, w2 = window_keys(values[part.start:part.stop], window)
                owner = owner + part.start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[owner], pa.int64()), pa.array(k2[owner], pa.int64()), pa.array(first[owner], pa.int64()),
                     pa.array(place, pa.int32()), pa.array(w1), pa.array(w2)],
                    names=["k1", "k2", "first", "place", "w1", "w2"])

    each = written(passages.mapInArrow(windows, "k1 long, k2 long, first long, place int, w1 long, w2 long"), "windows")
    # Stored, too: Spark can split a frequent window.
    smallest = written(each.groupBy("w1", "w2").agg(F.min("first").alias("smallest")), "smallest")
    bit = F.when(F.col("smallest") < F.col("first"), F.expr("shiftleft(1L, place)")).otherwise(F.lit(0).cast("long"))
    return each.join(smallest, ["w1", "w2"]).groupBy("k1", "k2").agg(
        F.min("first").alias("first"), F.bit_or(bit).alias("mask"))


def removals(docs: DataFrame, window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """doc_id, th (hash of the text) and spans: (start, n, mask) of the runs with windows that go."""
    runs = written(_find_runs(docs, window), "runs")
    shared = runs.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    # Stored first: a join of two plain shuffles is one whose large partitions Spark can split.
    shared = written(shared.select("anchor"), "anchors")
    # The runs of repeated rows fall together here, with a map-side minimum.
    members = written(runs.join(shared, "anchor", "left_semi").groupBy("doc_id", "th", "start").agg(
        *[F.min(c).alias(c) for c in ("n", "anchor", "k1", "k2")]), "shared_runs")
    distinct = members.groupBy("k1", "k2").agg(
        F.min(F.struct("doc_id", "th", "start", "n", "anchor")).alias("one")).select("k1", "k2", "one.*")
    distinct = written(distinct.withColumn("size", F.col("n") + (window - 1)).drop("n"), "distinct_runs")
    crowded = written(distinct.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor"), "crowded")
    plain = _passages(distinct.join(crowded, "anchor", "left_anti"), docs)
    sharded = plain.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        lambda batches: _gather(batches, window), "k1 long, k2 long, first long, mask long")
    crowds = _crowded_masks(_passages(distinct.join(crowded, "anchor", "left_semi"), docs), window)
    verdicts = written(sharded.unionByName(crowds), "verdicts")
    full = F.lit(-1).cast("long")
    return members.join(verdicts, ["k1", "k2"]).select(
        "doc_id", "th", "start", "n", F.when(F.col("doc_id") > F.col("first"), full).otherwise(F.col("mask")).alias("mask")
    ).where("mask <> 0").groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n", "mask")).alias("spans"))


def kept_words(words: list[bytes], spans: list[dict], window: int = WINDOW) -> list[bytes]:
    """`words` without those under a marked window."""
    change = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        bits = np.unpackbits(np.array([s["mask"]], np.int64).view(np.uint8), bitorder="little")[:s["n"]]
        at = s["start"] + np.flatnonzero(bits)
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
    stay = np.cumsum(change[:-1]) == 0
    return [w for w, s in zip(words, stay.tolist(), strict=True) if s]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """The rows of `docs`, with _sub_n_words, _sub_n_removed and _sub_kept (the kept words, joined by one space)."""
    marked = docs.withColumn("_sub_id", F.col("doc_id").cast("long")).withColumn("_sub_th", F.xxhash64(F.col("text").cast("binary")))
    spans = written(removals(docs, window, crowd), "spans").select(F.col("doc_id").alias("_sub_id"), F.col("th").alias("_sub_th"), "spans")
    joined = marked.join(spans.withColumnRenamed("spans", "_sub_spans"), ["_sub_id", "_sub_th"], "left").select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col("text").cast("binary").alias("_sub_text"), "_sub_spans")
    schema = joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.lit(0).cast("long").alias("_sub_n_words"),
                           F.lit(0).cast("long").alias("_sub_n_removed"), F.lit(b"").alias("_sub_kept")).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, own in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                words = (text.as_py() or b"").split()
                stay = kept_words(words, own.as_py(), window) if own.is_valid else words
                total.append(len(words))
                gone.append(len(words) - len(stay))
                kept.append(b" ".join(stay))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())],
                names=[f.name for f in schema.fields])

    return joined.mapInArrow(apply, schema)


def rewrite(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with the kept words as text where something was removed, and n_chars (if there) to match."""
    out = dedup_substrings(docs, window)
    changed = F.col("_sub_n_removed") > 0
    text = F.when(changed, F.col("_sub_kept").cast("string")).otherwise(F.col("text"))
    columns = {"text": text, "n_chars": F.when(changed, F.length(F.col("_sub_kept").cast("string"))).otherwise(F.col("n_chars")).cast(
        docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": text}
    return out.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])

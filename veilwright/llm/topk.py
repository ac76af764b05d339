"""Exact top-k search by inner product with MaxScore.

A component of a vector, split by sign, is a term; a vector's weight under it is the component's size. For a query the
terms whose sign matches raise the score by at most |query weight| times the term's largest weight in the shard, the
others can only lower it. Terms are put in order of that bound. Those whose bounds together stay below the k-th best
score so far are non-essential: a vector found in none of the essential terms' postings cannot get in. The essential
postings are traversed and added up, and the full scores of the best raise the k-th best score. The candidates are then
probed for the essential terms' opposite signs and in the other terms, the largest bound first, as long as their sum so
far and the bounds still open reach the k-th best.

Shards of vectors and blocks of queries have bounded sizes. Each block visits each shard, its best per shard are merged.
Rows are dealt out by their place in the table, so no value can make a shard large.

Nulls and odd cases: vectors that are null, empty or hold a null or non-finite component take no part, nor do rows with a
null id. Vectors of different lengths have no inner product: they are an error. Repeated ids are repeated candidates and
repeated queries, each with its own k best rows; only the row itself is no candidate. Equal scores go by the smaller id. An empty table gives an empty result; further
columns are ignored. Where a score might leave 64 bits, it is computed with whole numbers of any size; a weight or a found
score that does not fit in a bigint is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright.sources.scratch import written

#: Vectors of a shard, queries of a block, and as many blocks as there should be before blocks grow (to a shard's size at
#: most): every vector is sent to each block.
SHARD, BLOCK, BLOCKS = 20_000, 1_000, 16


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, weights): floor(scale * component) as integers, for the rows that take part."""
    parts = F.col("embedding").cast("array<double>")
    usable = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: F.floor(F.lit(float(scale)) * x)
    weight = lambda x: F.when(F.abs(F.lit(float(scale)) * x) < 2.0**63, scaled(x).cast("long")).otherwise(
        F.raise_error(F.lit("a vector's weight does not fit in a bigint")).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size(parts) > 0) & usable).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(parts, weight).alias("weights"))


@dataclass
class Postings:
    """Postings of one shard: per term (dimension, sign) its vectors, and the largest weight. `places` tell rows apart."""

    ids: np.ndarray
    places: np.ndarray
    matrix: np.ndarray

    def __post_init__(self) -> None:
        order = np.lexsort((self.places, self.ids))
        self.ids, self.places, self.matrix = self.ids[order], self.places[order], np.ascontiguousarray(self.matrix[order].T)
        self.positive = [np.flatnonzero(row > 0) for row in self.matrix]
        self.negative = [np.flatnonzero(row < 0) for row in self.matrix]
        self.most = np.maximum(self.matrix.max(axis=1), 0)
        self.least = np.minimum(self.matrix.min(axis=1), 0)
        self.size = np.maximum(self.most.astype(float), -self.least.astype(float))

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors for the query in place `own`; ties by the smaller id."""
        if float(np.abs(query.astype(float)) @ self.size) >= 2.0**61:  # sums of bounds and scores might overflow
            return self._best_wide(own, query, k)
        bounds = np.where(query > 0, query * self.most, query * self.least)
        order = np.argsort(-bounds, kind="stable")
        open_after = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)  # bounds of this term and all later ones
        threshold = self._first_threshold(own, query, int(order[0]), k)
        # The essential terms: the shortest head after which the rest alone cannot reach the threshold.
        essential = int(np.argmax(open_after < threshold)) if (open_after < threshold).any() else len(order)
        # Along the essential postings; a vector in none of them keeps 0, which the other terms cannot lift enough.
        score = np.zeros(len(self.ids), np.int64)
        for term in order[:essential].tolist():
            if query[term]:
                at = self.positive[term] if query[term] > 0 else self.negative[term]
                score[at] += query[term] * self.matrix[term][at]
        others, rest = self.places != own, open_after[essential]
        candidates = np.flatnonzero(others & (score + rest >= threshold))
        if len(candidates) > k:
            # The full scores of the best so far raise the threshold.
            size = min(len(candidates), 8 * k)
            full = query @ self.matrix[:, candidates[np.argpartition(-score[candidates], size - 1)[:size]]]
            if size >= k:
                threshold = max(threshold, int(np.partition(full, size - k)[size - k]))
            candidates = candidates[score[candidates] + rest >= threshold]
        partial = score[candidates]
        for term in order[:essential].tolist():  # the essential terms' opposite signs, which only lower a score
            if query[term]:
                partial = partial + np.minimum(query[term] * self.matrix[term][candidates], 0)
                stay = partial + rest >= threshold
                if not stay.all():
                    candidates, partial = candidates[stay], partial[stay]
        for place in range(essential, len(order)):
            term = int(order[place])
            if query[term]:
                partial = partial + query[term] * self.matrix[term][candidates]
            if len(partial) > k:
                # Penalties of terms not probed yet can only lower a score, so the k-th partial sum is no threshold;
                # what is known from full scores is.
                stay = partial + open_after[place + 1] >= threshold
                if not stay.all():
                    candidates, partial = candidates[stay], partial[stay]
        top = np.lexsort((self.ids[candidates], -partial))[:k]
        return self.ids[candidates[top]], partial[top]

    def _best_wide(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same by Python's whole numbers, of all vectors."""
        others = np.flatnonzero(self.places != own)
        scores = [0] * len(others)
        for weight, row in zip(query.tolist(), self.matrix, strict=True):
            if weight:
                scores = [s + weight * w for s, w in zip(scores, row[others].tolist(), strict=True)]
        top = sorted(range(len(others)), key=lambda i: -scores[i])[:k]  # places are in the ids' order
        if any(not -(1 << 63) <= scores[i] < 1 << 63 for i in top):
            raise OverflowError("a score does not fit in a bigint")
        return self.ids[others[top]], np.array([scores[i] for i in top], np.int64)

    def _first_threshold(self, own: int, query: np.ndarray, term: int, k: int) -> int:
        """A k-th best score that some vectors really have: those with the largest weights under the best terms."""
        size = min(len(self.ids), 8 * k + 1)
        strongest = np.argpartition(-(self.matrix[term] * query[term]), size - 1)[:size]
        strongest = strongest[self.places[strongest] != own]
        if len(strongest) < k:
            return -(1 << 62)
        full = query @ self.matrix[:, strongest]
        return int(np.partition(full, len(full) - k)[len(full) - k])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, shard: int = SHARD,
          block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best other rows."""
    stored = written(quantized(vectors, scale).withColumn("place", F.monotonically_increasing_id()), "vectors")
    sizes = stored.groupBy(F.size("weights").alias("n")).count().limit(2).collect()
    if len(sizes) > 1:
        raise ValueError("vectors of different lengths have no inner product")
    rows = sizes[0]["count"] if sizes else 0
    shards = max(1, -(-rows // shard))
    queries = stored.where(is_query)
    asked_for = queries.count()
    blocks = max(1, -(-asked_for // max(block, min(shard, asked_for // BLOCKS))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    side = stored.select("vec_id", "place", "weights", F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int").alias("s"), every(blocks).alias("b"))
    asked = queries.select("vec_id", "place", "weights", every(shards).alias("s"), F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int").alias("b"))
    both = side.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))

    def one_cell(table: pa.Table) -> pa.Table:
        ids, places, asks = (table[c].to_numpy(zero_copy_only=False) if c == "asks" else table[c].to_numpy() for c in ("vec_id", "place", "asks"))
        weights = table["weights"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        out: list[tuple] = []
        if (~asks).any():
            postings = Postings(ids[~asks], places[~asks], weights[~asks])
            for own, place, query in zip(ids[asks].tolist(), places[asks].tolist(), weights[asks], strict=True):
                found, scores = postings.best(place, query, k)
                out += [(own, place, int(v), int(s)) for v, s in zip(found, scores, strict=True)]
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "place", "vec_id", "score"])

    found = both.groupBy("s", "b").applyInArrow(one_cell, "query_id long, place long, vec_id long, score long")
    order = Window.partitionBy("query_id", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")

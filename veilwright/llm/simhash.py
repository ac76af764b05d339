"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

Fingerprints: 64 bits per text over its word shingles. Equal fingerprints are collapsed first, so exact copies cost one
row whatever their number. The distinct ones are cut into three segments of at most 23 bits. Two fingerprints that
differ in at most two bits agree in one segment and differ by at most one bit in the next one or in the one after; going
round the three segments, some (equal segment, next segment) pair has no error in the first and at most one in the
second. The binary Golay code of length 23 is perfect: each word lies within three bits of exactly one codeword. So the
second segment is keyed by the index of its codeword, and, for the probing side, by the codewords of all its one-bit
neighbours (one to six keys); one shared key is certain, and each joined pair is verified on all 64 bits.

Keys under which more than `CROWD` fingerprints lie are not joined: their fingerprints are grouped by common centres
(the points at most one bit away). Two fingerprints are within two bits exactly if they share such a centre, and a centre
has at most 65 of them, so a crowd of any size costs 65 rows each and loses no link.

Nulls and odd cases: a null or empty text has fingerprint 0 and links like any other. A null doc_id never names a
component that has another id; a component of null ids only has a null id. Repeated rows share a component. An empty
table gives an empty result; further columns are ignored. Texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwright.sources.scratch import written

from .components import connected

#: Fingerprints under one key, up to which all its pairs are looked at.
CROWD = 256
SEED = 42
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GENERATOR = 0xAE3


# --- fingerprints --------------------------------------------------------------------------


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fingerprint (signed 64-bit) of every row."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, hashes, counts = np.zeros(len(batch), np.uint64), [], []
            pending: list[int] = []
            for i, text in enumerate(batch.column(1)):
                own = shingle_hashes(text.as_py() or b"", shingle)
                if own:
                    hashes += own
                    counts.append(len(own))
                    pending.append(i)
                if len(hashes) > 200_000:
                    found[pending] = majorities(np.array(hashes, np.uint64), np.array(counts))
                    hashes, counts, pending = [], [], []
            if pending:
                found[pending] = majorities(np.array(hashes, np.uint64), np.array(counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(over, "doc_id long, fp long")


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 of each run of `shingle` lower-cased words, joined by spaces; of all words, if there are fewer."""
    from xxhash import xxh64_intdigest as digest

    words = text.lower().split()  # of bytes: A-Z only, and exactly the blanks 0x20 and 0x09-0x0D
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]])
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[shingle - 1:] - 1).tolist(), strict=True)]


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per run of `counts` hashes, the word whose bits are set in over half of them.

    Eight bits at a time are added up as the eight bytes of one word, in blocks of at most 255 hashes.
    """
    blocks = -(-counts // 255)
    first = np.repeat(np.cumsum(counts) - counts, blocks)
    firsts_of_runs = np.cumsum(blocks) - blocks
    starts = first + 255 * (np.arange(len(first)) - np.repeat(firsts_of_runs, blocks))
    out = np.zeros(len(counts), np.uint64)
    lanes = np.uint64(0x0101010101010101)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & lanes, starts)
        by_byte = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), firsts_of_runs, axis=0)
        set_bits = (2 * by_byte > counts[:, None]).astype(np.uint64)
        for byte in range(8):
            out |= set_bits[:, byte] << np.uint64(8 * byte + k)
    return out


# --- Golay code ----------------------------------------------------------------------------


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - 11))
    return rest


def _errors() -> np.ndarray:
    """The only error of at most three bits that has a syndrome, by syndrome."""
    one = 1 << np.arange(23)
    two = (one[:, None] | one[None, :]).ravel()
    patterns = np.unique(np.concatenate([[0], (two[:, None] | one[None, :]).ravel()]))
    table = np.zeros(2048, np.int64)
    table[syndrome(patterns)] = patterns
    return table


ERRORS = _errors()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12 data bits of the codeword nearest to each 23-bit word."""
    return (words ^ ERRORS[syndrome(words)]) >> 11


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, key, is it the own codeword's key?) of each distinct key of every fingerprint."""
    bits = fps.view(np.uint64)
    parts = [((bits >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    rows, found, home = [], [], []
    for scheme in range(3):
        equal, near, width = parts[scheme], parts[(scheme + 1) % 3], SEGMENTS[(scheme + 1) % 3][1]
        options = np.stack([codeword_index(near), *[codeword_index(near ^ (1 << bit)) for bit in range(width)]], 1)
        prefix = (scheme << 40) | (equal << 12)
        own = prefix | options[:, 0]
        options.sort(axis=1)
        fresh = np.ones(options.shape, bool)
        fresh[:, 1:] = options[:, 1:] != options[:, :-1]
        at, column = np.nonzero(fresh)
        key = prefix[at] | options[at, column]
        rows.append(at)
        found.append(key)
        home.append(key == own[at])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(home)


# --- links and components ------------------------------------------------------------------


def links(distinct: DataFrame, bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column fp) that tie all within `bits` (at most 2) together.

    Every pair outside crowds is there; a crowd gives a star per centre, which joins the same fingerprints.
    """
    if not 0 <= bits <= 2:
        raise ValueError("three segments find differences of at most two bits")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            at, key, home = keys(fps)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[at]), pa.array(home)], names=["key", "fp", "home"])

    keyed = written(distinct.select("fp").mapInArrow(emit, "key long, fp long, home boolean"), "golay")
    homes = keyed.where("home")
    crowded = homes.groupBy("key").count().where(F.col("count") > crowd).select("key")
    quiet = homes.join(crowded, "key", "left_anti").select("key", F.col("fp").alias("b"))
    pairs = keyed.select("key", F.col("fp").alias("a")).join(quiet, "key").where(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b")
    members = keyed.join(crowded, "key", "left_semi").select("fp").distinct()
    return pairs.unionByName(_stars(members, bits)).distinct()


def _stars(members: DataFrame, bits: int) -> DataFrame:
    """Links of crowded fingerprints through their common centres."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    around = members.select("fp", F.explode(flips if bits else F.array(F.lit(0).cast("long"))).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    if bits == 1:  # only a centre that is a member itself is one bit away from the others
        mine = Window.partitionBy("centre")
        around = around.withColumn("real", F.max(F.col("fp") == F.col("centre")).over(mine)).where("real")
        return around.where("fp <> centre").select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b"))
    least = F.min("fp").over(Window.partitionBy("centre"))
    return around.select(least.alias("a"), F.col("fp").alias("b")).where("a < b")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    found = written(fingerprints(docs, shingle), "fingerprints")
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected(links(distinct, bits))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    # Stored, and the aggregate too: Spark can split the fingerprints of a giant component.
    rooted = written(rooted, "rooted")
    smallest = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest_ids")
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """The rows of `docs` that are the first of their component, with their own columns.

    Rows with the same doc_id stay or go together. Rows without an id stay only if no row with an id is in their component.
    """
    near = near_duplicates(docs, shingle, bits)
    first = near.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_first")).distinct()
    return docs.join(first, docs["doc_id"].cast("long").eqNullSafe(first["_first"]), "left_semi")

"""Phrase collocation mining by SON partitioning.

Phrases are 2 to 4 neighbouring words of one piece, counted per language. The corpus is parted into `SHARDS` shards, each of
which is mined completely at a support lowered in proportion: (support - 1) // SHARDS + 1, so that what all shards may hide
together stays below the support. The phrases that are frequent in some shard are united, and all of them are then counted
over the whole corpus, by their words, exactly.

* The number of shards does not depend on the corpus, or local supports would fall to 1. A shard is mined by many tasks:
  every block of text gives the counts of its phrases, and blocks of one shard are added up by an aggregate.
* A phrase cannot be more frequent than its parts, so words are counted first, then pairs are mined among frequent words
  and longer phrases among candidate pairs. Phrases travel as 64-bit hashes there: equal hashes can only add candidates.
* Candidates reach the tasks as a bit set of bounded size (`MOST_BITS`). A false hit is counted, and dropped for its count.

Nulls and odd cases: a null text is empty, a null language is `und`. Repeated rows count each time; ids play no part. A very
long text is cut into blocks at blanks, each of which sees the three words behind it, so no phrase is lost. An empty table
gives an empty result; further columns are ignored. In text that is no UTF-8 the byte 0xFF ends a piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from veilwright.sources.scratch import written

from .batches import mix64

#: Shards; bytes of text of one block; words of the longest phrase; bits of the candidates' set, at most (16 MB).
SHARDS, BLOCK, LONGEST, MOST_BITS = 6, 6 << 20, 4, 1 << 27

BREAK = b"\xff"
#: A-Z in lower case, and every byte that ends a piece as one sign.
_PREPARED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 10)
_SEPARATOR = re.compile(rb"[ \t\xff]")
_LOOKAHEAD = re.compile(rb"(?:[ \t]*[^ \t\xff]+){0,%d}" % (LONGEST - 1))
_JOIN = np.uint64(0x9FB21C651E98DF25)


class Block:
    """Words of a block of text as numbers; number 0 is the end of a piece. Phrases start in the first `starts` places."""

    def __init__(self, lang: str, text: bytes, behind: bytes = b"") -> None:
        numbers = {BREAK: 0}
        own, after = [part.replace(BREAK, b" " + BREAK + b" ").split() for part in (text, behind)]
        # A piece's end behind everything: no phrase reaches over it.
        self.ids = np.array([numbers.setdefault(w, len(numbers)) for w in own + after] + [0], np.int64)
        self.lang, self.starts, self.words = lang, len(own), list(numbers)

    def counts(self) -> np.ndarray:
        """Occurrences of each word; none of number 0."""
        found = np.bincount(self.ids[:self.starts], minlength=len(self.words))
        found[0] = 0
        return found

    def hashes(self) -> np.ndarray:
        """What `xxhash64(lang, word)` gives in a DataFrame, unsigned."""
        seed = xxh64_intdigest(self.lang.encode(), 42)
        return np.array([xxh64_intdigest(w, seed) for w in self.words], np.uint64)

    def phrases(self, allowed: "BitSet", longest: int, sieve: "BitSet | None" = None, sieved: int = LONGEST):
        """(length, word numbers, hashes, counts) of the phrases of 2..longest words whose words are `allowed`.

        Up to `sieved` words only those in `sieve` go on, and longer ones are made of such.
        """
        ids, many = self.ids, len(self.words)
        hashes = self.hashes()
        word_ok = allowed.holds(hashes)
        word_ok[0] = False
        # Per place: the number of the phrase of `length` words that starts there, or -1.
        here = np.where(word_ok[ids], ids, -1)
        rows, keys = np.arange(many)[:, None], hashes
        for length in range(2, longest + 1):
            whole = np.flatnonzero((here[:-1] >= 0) & (here[1:] >= 0))
            whole = whole[whole + length <= len(ids)]
            unique, inverse = np.unique(here[whole] * many + ids[whole + length - 1], return_inverse=True)
            head, last = unique // many, unique % many
            keys = mix64(keys[head] * _JOIN + hashes[last])
            rows = np.concatenate([rows[head], last[:, None]], axis=1)
            counts = np.bincount(inverse[whole < self.starts], minlength=len(unique))
            stay = sieve.holds(keys) if sieve is not None and length <= sieved else np.ones(len(keys), bool)
            yield length, rows[stay], keys[stay], counts[stay]
            renumbered = np.where(stay, np.cumsum(stay) - 1, -1)
            here = np.full(len(ids), -1, np.int64)
            here[whole] = renumbered[inverse]
            rows, keys = rows[stay], keys[stay]

    def text_of(self, row: np.ndarray) -> bytes:
        return b" ".join([self.words[i] for i in row.tolist()])


class BitSet:
    """A set of 64-bit hashes that may hold more than was put in, never less."""

    def __init__(self, bits: np.ndarray, size: int) -> None:
        self._bits, self._mask = bits, np.uint64(size - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & self._mask
        return (self._bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

    @staticmethod
    def of(hashes: DataFrame, column: str, most_bits: int = MOST_BITS) -> "BitSet":
        """The set of a stored column of longs: 4 KB a bucket come to the driver, `most_bits` / 8 bytes in all at most."""
        size = 1 << 16
        wanted = 16 * hashes.count()
        while size < wanted and size < most_bits:
            size *= 2
        place = F.col(column).bitwiseAND(F.lit(size - 1)) + 1  # buckets begin with 1
        parts = hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
        bits = np.zeros(size // 8, np.uint8)
        for part in parts:
            at = (part["bucket"] - 1) * 4096
            bits[at:at + 4096] = np.frombuffer(part["bits"], np.uint8)
        return BitSet(bits, size)


def segments(text: bytes, most: int) -> Iterator[tuple[bytes, bytes]]:
    """A prepared text in blocks of about `most` bytes, cut at separators, each with the words behind it in its piece."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > most and (found := _SEPARATOR.search(text, at + most)):
            end = found.end()
        behind = b"" if text[end - 1:end] == BREAK else _LOOKAHEAD.match(text, end).group()
        yield text[at:end], behind
        at = end


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Block]:
    """The blocks of a stream of (lang, text), of one language each. What waits for its block to fill is `most` bytes and one text at most."""
    waiting: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def close(lang: str) -> Block:
        sizes.pop(lang)
        return Block(lang, BREAK.join(waiting.pop(lang)))

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            prepared = (text.as_py() or b"").translate(_PREPARED)
            if len(prepared) > most:
                for part, behind in segments(prepared, most):
                    yield Block(lang, part, behind)
            elif prepared:
                waiting.setdefault(lang, []).append(prepared)
                sizes[lang] = sizes.get(lang, 0) + len(prepared) + 1
                if sum(sizes.values()) >= most:
                    yield close(max(sizes, key=sizes.get))
    for lang in list(waiting):
        yield close(lang)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def count_words(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, phrase, a): occurrences of every word."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, block):
            n = b.counts()
            found = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.lang] * len(found), pa.string()), pa.array([b.words[i] for i in found.tolist()], pa.binary()),
                 pa.array(n[found], pa.int64())], names=["lang", "phrase", "a"])

    each = _texts(docs).mapInArrow(over, "lang string, phrase binary, a long")
    return each.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def mine(docs: DataFrame, words: BitSet, support: int, pairs: BitSet | None = None, block: int = BLOCK,
         shards: int = SHARDS) -> DataFrame:
    """(key) of the phrases that are frequent in some shard: pairs, or the longer ones made of `pairs`."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        for b in blocks(batches, block):
            for length, _, hashes, counts in b.phrases(words, 2 if pairs is None else LONGEST, pairs, sieved=2):
                if pairs is None or length > 2:
                    found = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), shard, np.int8)), pa.array(hashes[found].view(np.int64)), pa.array(counts[found])],
                        names=["shard", "key", "n"])

    each = _texts(docs).mapInArrow(over, "shard byte, key long, n long")
    # A phrase below this in every shard has at most shards * (local - 1) < support occurrences.
    local = (support - 1) // shards + 1
    return each.groupBy("shard", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= local).select("key").distinct()


def count_phrases(docs: DataFrame, words: BitSet, candidates: BitSet, block: int = BLOCK) -> DataFrame:
    """(lang, phrase, k, a): exact counts, by their words, of the phrases in `candidates`."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, block):
            for length, rows, _, counts in b.phrases(words, LONGEST, candidates):
                found = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.lang] * len(found), pa.string()), pa.array([b.text_of(rows[i]) for i in found.tolist()], pa.binary()),
                     pa.array([length] * len(found), pa.int32()), pa.array(counts[found], pa.int64())],
                    names=["lang", "phrase", "k", "a"])

    each = _texts(docs).mapInArrow(over, "lang string, phrase binary, k int, a long")
    return each.groupBy("lang", "phrase", "k").agg(F.sum("a").alias("a"))


def frequent_phrases(docs: DataFrame, support: int = 30, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables (lang, phrase, k, a) of the phrases of 2 to 4 words and (lang, phrase, a) of the words that occur `support`
    times, and (lang, n) of all words."""
    words = written(count_words(docs, block), "words")
    n = written(words.groupBy("lang").agg(F.sum("a").alias("n")), "languages")
    words = words.where(F.col("a") >= support)
    allowed = BitSet.of(words.select(F.xxhash64("lang", "phrase").alias("key")), "key")
    pairs = written(mine(docs, allowed, support, None, block), "pairs")
    longer = written(mine(docs, allowed, support, BitSet.of(pairs, "key"), block), "longer")
    united = BitSet.of(pairs.unionByName(longer), "key")
    counted = count_phrases(docs, allowed, united, block).where(F.col("a") >= support)
    return written(counted, "phrases"), words, n


def collocations(docs: DataFrame, support: int = 30, most: int = 2000, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's `most` best phrases.

    A phrase's score is that of its worst cut, floor(2000000 * a / (l + r)) for the frequencies l and r of both sides.
    Phrases inside a longer one that is at least four fifths as frequent are left out.
    """
    phrases, words, n = frequent_phrases(docs, support, block)
    known = written(phrases.select("lang", "phrase", "a").unionByName(words.select("lang", "phrase", "a")), "known")
    text = F.col("phrase").cast("string")
    cuts = phrases.select("lang", text.alias("phrase"), "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', cut)")).withColumn(
        "rest", F.expr("substring_index(phrase, ' ', cut - k)"))
    side = known.select("lang", text.alias("part"), F.col("a").alias("f"))
    cuts = cuts.join(side.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"]).join(
        side.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"])
    wide = "cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))"
    worst = F.min(F.struct(F.expr(wide).alias("score"), "cut", "l", "r")).alias("worst")
    scored = cuts.groupBy("lang", "phrase", "a").agg(worst).select("lang", "phrase", "a", "worst.score", "worst.l", "worst.r")
    inner = phrases.where("k > 2").select("lang", text.alias("whole"), "k", "a", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
    inner = inner.select("lang", "whole", "a", "m", F.explode(F.sequence(F.col("m"), F.col("k"))).alias("until")).select(
        "lang", F.expr("substring_index(substring_index(whole, ' ', until), ' ', -m)").alias("phrase"), "a")
    # Stored: so the join is one of plain tables.
    around = written(inner.groupBy("lang", "phrase").agg(F.max("a").alias("around")), "around")
    kept = scored.join(around, ["lang", "phrase"], "left").where(
        "around is null or 5 * cast(around as decimal(19, 0)) < 4 * cast(a as decimal(19, 0))")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

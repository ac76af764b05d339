"""Cross-tokenizer alignment: which tokens of two tokenizers end at the same byte of a text?

Both tokenizations of a batch are walked by lockstep merging: a NumPy state vector holds one pointer into the ends of A's
tokens and one into those of B's for every walker, and each step moves them all at once. Where both tokens end at the same
byte, the step emits a link and a cut; else the pointer that is behind moves on. Walkers that have reached their end are
compacted away. What lies behind a byte does not matter to a walk, so long texts are walked by several walkers, one for
`STRIDE` bytes each, and the number of steps does not grow with a text.

A is a byte-level tokenizer of the tokenizers library and gets a space and the text; B is a sentencepiece model with byte
fallback, which adds that space itself. Two tokens can only be linked if one ends with the other's bytes, so the possible
pairs are listed from the vocabularies alone: a few hundred thousand, however large the corpus. Links are stored as numbers
of such pairs, and their corpus-wide counts can be given to every task.

Nulls and odd cases: null and empty texts and those whose tokens do not give back space and text have no tokens, nor
links. A null doc_id is kept; repeated rows are aligned and counted one by one; texts of any length are aligned whole. An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.sources.scratch import written

from .batches import bounded, ragged_arange

#: Characters of text aligned together (a longer text stands alone); bytes of text that one walker walks over.
CHUNK, STRIDE = 1 << 20, 1024
#: Characters of a unit that may be remembered, and units that are.
WORD, REMEMBERED = 1 << 16, 200_000
SPACE = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")


def letters_of_bytes() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, the others as letters from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)).difference(printable))
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenizerA:
    """A byte-level tokenizer of the tokenizers library; special tokens in a text are ordinary text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on every core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters = letters_of_bytes()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            if all(c in letters for c in token):
                self.bytes[number] = bytes([letters[c] for c in token])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class TokenizerB:
    """A sentencepiece model that puts a space before the text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for number in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(number)
            if self._model.is_byte(number):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif self._model.is_control(number) or self._model.is_unknown(number):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace(SPACE, " ").encode())
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"{path}: piece {number} reaches over a space")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1) if texts else []


class Pairs:
    """All pairs of an A and a B token that may end together, numbered in the order of their keys."""

    def __init__(self, a: list[bytes], b: list[bytes]) -> None:
        self.width = len(b)
        self.keys = np.unique(np.concatenate([
            _suffix_keys(a, b, lambda long, short: long * self.width + short),
            _suffix_keys(b, a, lambda long, short: short * self.width + long)]))

    def __len__(self) -> int:
        return len(self.keys)

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a * self.width + b).astype(np.int32)

    def b_tokens(self) -> np.ndarray:
        return self.keys % self.width


def _suffix_keys(long: list[bytes], short: list[bytes], key) -> np.ndarray:
    """Keys of the pairs whose second token's bytes end the first one's."""
    by_bytes: dict[bytes, list[int]] = {}
    for number, token in enumerate(short):
        if token:
            by_bytes.setdefault(token, []).append(number)
    found = [key(i, j) for i, token in enumerate(long) for at in range(len(token)) for j in by_bytes.get(token[at:], ())]
    return np.array(found, np.int64)


@dataclass
class Aligned:
    """Links of a batch of texts, text after text: places of the linked tokens, and the first link of every text."""

    a: np.ndarray
    b: np.ndarray
    first: np.ndarray


def lockstep(ends_a: np.ndarray, first_a: np.ndarray, ends_b: np.ndarray, first_b: np.ndarray, stride: int = STRIDE) -> Aligned:
    """Merge the token ends of a batch of texts.

    `ends` hold the bytes at which tokens end, counted through the whole batch (so they rise), `first` the place of every
    text's first token and the end of the last one. Both sides of a text end at the same byte.
    """
    texts = len(first_a) - 1
    total = int(ends_a[-1]) if len(ends_a) else 0
    # A walker starts at each multiple of `stride` and takes the ends up to the next one.
    borders = np.append(np.arange(0, total, stride), total) if total else np.zeros(1, np.int64)
    at_a, at_b = (np.searchsorted(ends, borders, side="right") for ends in (ends_a, ends_b))
    a, b, stop_a, stop_b = at_a[:-1], at_b[:-1], at_a[1:], at_b[1:]
    found_a, found_b = [], []
    while True:
        # Compaction: a walker without tokens left on either side has no further link.
        walking = (a < stop_a) & (b < stop_b)
        if not walking.all():
            a, b, stop_a, stop_b = a[walking], b[walking], stop_a[walking], stop_b[walking]
        if not len(a):
            break
        end_a, end_b = ends_a[a], ends_b[b]
        together = end_a == end_b
        found_a.append(a[together])
        found_b.append(b[together])
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
    linked_a = np.sort(np.concatenate(found_a)) if found_a else np.zeros(0, np.int64)
    linked_b = np.sort(np.concatenate(found_b)) if found_b else np.zeros(0, np.int64)
    return Aligned(linked_a, linked_b, np.searchsorted(linked_a, first_a) if texts else np.zeros(1, np.int64))


class Aligner:
    """Both tokenizers, the pairs of their tokens that may be linked, and the tokens of units met lately.

    A unit is a stretch of text between two single blanks that stand between other signs. Neither tokenizer has a token over
    such a blank, and both put it before what follows, so a text's tokens are those of its units, each behind a space.
    Units of up to `WORD` signs are remembered, `REMEMBERED` of them at most.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        self.sides = TokenizerA(path_a), TokenizerB(path_b)
        self.pairs = Pairs(*[side.bytes for side in self.sides])
        self._lengths = [np.array([len(t) for t in side.bytes], np.int64) for side in self.sides]
        # A token of a group's A side, the last one of it, and the last one of its B side.
        self._shown = [f"{i}{mark}" for i in range(max(len(side.bytes) for side in self.sides)) for mark in ",|;"]
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._right = np.zeros(0, bool)
        self._ids = [np.zeros(0, np.int64) for _ in self.sides]
        self._first = [np.zeros(1, np.int64) for _ in self.sides]

    def _learn(self, units: list[str]) -> None:
        """Number and tokenize units that are not known."""
        data = b" " + " ".join(units).encode()
        sizes = np.fromiter((len(u) if u.isascii() else len(u.encode()) for u in units), np.int64, len(units)) + 1
        right = np.ones(len(units), bool)
        for k, side in enumerate(self.sides):
            ids = side.encode(units)
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))
            # All at once: the same bytes in all, and as many of them in each.
            ends = np.append(0, np.cumsum(self._lengths[k][flat]))[np.append(0, np.cumsum(counts))]
            alike = (ends[1:] - ends[:-1]) == sizes
            if not alike.all() or b"".join(map(side.bytes.__getitem__, chain.from_iterable(ids))) != data:
                alike = np.array([b"".join(map(side.bytes.__getitem__, own)) == b" " + unit.encode() for own, unit in zip(ids, units, strict=True)])
            right &= alike
            self._ids[k] = np.concatenate([self._ids[k], flat])
            self._first[k] = np.concatenate([self._first[k], self._first[k][-1] + np.cumsum(counts)])
        self._known.update(zip(units, range(len(self._right), len(self._right) + len(units)), strict=True))
        self._right = np.concatenate([self._right, right])

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Flat ids of both sides, each with the first place of every text; none where they do not give back the text."""
        split = [_CUT.split(t) if t else [] for t in texts]
        if len(self._known) > REMEMBERED:
            self._forget()
        # In the order met, so that a run does not depend on hashing.
        missing = [u for u in dict.fromkeys(chain.from_iterable(split)) if u not in self._known]
        if missing:
            self._learn(missing)
        units = np.fromiter(map(self._known.__getitem__, chain.from_iterable(split)), np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(own) for own in split])
        right = np.bincount(owner[~self._right[units]], minlength=len(texts)) == 0
        units, owner = units[right[owner]], owner[right[owner]]
        out = []
        for ids, first in zip(self._ids, self._first, strict=True):
            sizes = (first[1:] - first[:-1])[units]
            flat = ids[np.repeat(first[units], sizes) + ragged_arange(sizes)]
            of_text = np.bincount(owner, sizes, minlength=len(texts)).astype(np.int64)
            out.append((flat, np.concatenate([[0], np.cumsum(of_text)])))
        if any(len(u) > WORD for u in missing):
            self._forget()
        return out

    def align(self, texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], Aligned]:
        sides = self.tokens(texts)
        ends = [np.cumsum(lengths[ids]) for lengths, (ids, _) in zip(self._lengths, sides, strict=True)]
        return sides, lockstep(ends[0], sides[0][1], ends[1], sides[1][1])

    def groups(self, sides: list[tuple[np.ndarray, np.ndarray]], links: Aligned) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of every text: the tokens between neighbouring cuts."""
        (a, first_a), (b, first_b) = sides
        # The group of each token, and its place when all groups are written one behind the other.
        group_a, group_b = (np.cumsum(np.bincount(linked + 1, minlength=len(ids) + 1))[:-1] if len(ids) else linked
                            for linked, ids in ((links.a, a), (links.b, b)))
        place_a = np.arange(len(a)) + np.concatenate([[0], links.b + 1])[group_a]
        place_b = np.arange(len(b)) + (links.a + 1)[group_b]
        shown = np.empty(len(a) + len(b), np.int64)
        shown[place_a], shown[place_b] = 3 * a, 3 * b
        shown[place_a[links.a]] += 1
        shown[place_b[links.b]] += 2
        first = first_a + first_b
        return ["".join(map(self._shown.__getitem__, shown[first[k]:first[k + 1]].tolist()))[:-1] for k in range(len(first) - 1)]


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, groups (`a1,a2|b1;a3|b2,b3`) and links (numbers of pairs, little-endian 32-bit) of every row."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            values = [t.as_py() or "" for t in batch.column(1)]
            for part in bounded(values, CHUNK):
                sides, links = aligner.align(values[part.start:part.stop])
                (a, first_a), (b, first_b) = sides
                numbers = aligner.pairs.numbers(a[links.a], b[links.b])
                own = [numbers[links.first[k]:links.first[k + 1]].tobytes() for k in range(len(part))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, len(part)), pa.array(np.diff(first_a)), pa.array(np.diff(first_b)),
                     pa.array(aligner.groups(sides, links), pa.string()), pa.array(own, pa.binary())],
                    names=["doc_id", "n_a", "n_b", "groups", "links"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(over, "doc_id long, n_a long, n_b long, groups string, links binary")


def count_links(aligned: DataFrame, pairs: int) -> DataFrame:
    """(pair, n): how many links of all rows are of each pair. A task adds its links up before anything is shuffled."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(pairs, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=pairs)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["pair", "n"])

    each = aligned.select("links").mapInArrow(over, "pair int, n long")
    return each.groupBy("pair").agg(F.sum("n").alias("n"))


def with_counts(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """`aligned` (stored) with n_links, n_best and count_sum in the place of its links."""
    pairs = Aligner(path_a, path_b).pairs
    counted = count_links(aligned, len(pairs)).collect()  # one row a possible pair of two vocabularies at most
    counts = np.zeros(len(pairs), np.int64)
    for row in counted:
        counts[row["pair"]] = row["n"]
    b_tokens = pairs.b_tokens()
    highest = np.zeros(pairs.width, np.int64)
    np.maximum.at(highest, b_tokens, counts)
    best = counts == highest[b_tokens]
    passed = [c for c in aligned.columns if c != "links"]
    schema = aligned.select(*passed, *[F.lit(0).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]).schema

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for links in batch.column(len(passed)):
                own = np.frombuffer(links.as_py(), "<i4")
                rows.append((len(own), int(best[own].sum()), int(counts[own].sum())))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(passed)], *[pa.array(c, pa.int64()) for c in columns]],
                                             names=schema.names)

    return aligned.select(*passed, "links").mapInArrow(over, schema)

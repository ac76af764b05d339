"""SentencePiece encoding and decoding by suffix-array matching.

A batch's words (white space begins a word, and no piece reaches over such a border) that the worker has not met yet are
concatenated and indexed by a suffix array; a binary search of every piece gives its range of occurrences. Each
occurrence is an edge from its first to its last character. Edges are sorted by the position they end at and relaxed, all
words at once: an edge is taken if its piece may follow the one that the best path to its start ends with.

For byte-pair models "may follow" has an exact meaning: the piece and its forerunner must not contain a pair over
their border that would have been merged earlier. One path per position passes, and it is what merging pair by pair gives.

Models: byte-pair with byte fallback, identity normalisation, a dummy prefix and no removal of white space; others are
refused. Nulls and odd cases: a null text has null ids, an empty one none. A null doc_id is kept. Repeated rows are
encoded one by one; an empty table gives an empty result; further columns are ignored. Texts of any length are encoded
whole: their words are indexed in parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bounded, mix64, ragged_arange

#: Words that a worker remembers, in two generations of so many each; bytes of text treated at a time.
REMEMBERED, CHUNK = 200_000, 2 << 20
#: Bytes of new words that are indexed together (a longer word stands alone): every byte takes part in some five edges.
INDEXED = 192 << 10
#: Bits of the number of remembered pairs of pieces.
MEMORY = 21
SPACE = "▁".encode()
#: Words with the blanks before them; blanks before a line end; line ends.
WORDS = re.compile(rb" *[^ \n]+| +|\n+")
NORMAL, BYTE = 1, 6


class PieceModel:
    """Pieces in the order of their merges: single characters first, then the others by falling score."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, rule = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or not spec.byte_fallback or rule.name != "identity" or rule.remove_extra_whitespaces \
                or not rule.add_dummy_prefix or not rule.escape_whitespaces:
            raise ValueError("only byte-pair models with byte fallback, a dummy prefix and identity normalisation")
        pieces = [(p.piece, p.score, i) for i, p in enumerate(model.pieces) if p.type == NORMAL]
        if any("▁" in p.lstrip("▁") or "\n" in p for p, _, _ in pieces):
            raise ValueError("a piece reaches over the border of a word")
        pieces.sort(key=lambda p: (len(p[0]) > 1, -p[1], p[2]))
        self.texts = [p[0] for p in pieces]
        self.ids = np.array([p[2] for p in pieces], np.uint32)
        self.count = len(pieces)
        number = {p: k for k, p in enumerate(self.texts)}
        self.bytes_ids = np.zeros(256, np.uint32)
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.bytes_ids[int(p.piece[3:5], 16)] = i
        # Every way to cut a piece into two pieces is a pair that can merge.
        pairs = [(number[p[:k]] * (self.count + 1) + number[p[k:]], m) for m, p in enumerate(self.texts)
                 for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        pairs.sort()
        self._pairs, self._merged = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        merge = dict(pairs)
        # The two parts a piece was last merged from; a single character (and the unknown one, the last) is its own part.
        self.left, self.right = np.arange(self.count + 1), np.arange(self.count + 1)
        reached = np.ones(self.count, bool)
        for m, p in enumerate(self.texts):
            if len(p) > 1:
                last = self._last_merge([number.get(c, self.count) for c in p], merge)
                reached[m] = last is not None and merge[last[0] * (self.count + 1) + last[1]] == m
                if reached[m]:
                    self.left[m], self.right[m] = last
        self._patterns(np.flatnonzero(reached))
        self._met, self._met_fine = np.full(1 << MEMORY, -1), np.zeros(1 << MEMORY, bool)
        self.decoded = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            self.decoded[i] = (p.piece.encode().replace(SPACE, b" ") if p.type == NORMAL else
                               bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else " ⁇ ".encode() if p.type == 2 else b"")

    def _last_merge(self, symbols: list[int], merge: dict[int, int]) -> tuple[int, int] | None:
        """Merge pair by pair, the best first, until one symbol is left; the parts of the last merge."""
        last = None
        while len(symbols) > 1:
            best = min(((merge.get(a * (self.count + 1) + b, self.count), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))))
            if best[0] == self.count:
                return None
            k = best[1]
            last = (symbols[k], symbols[k + 1])
            symbols = [*symbols[:k], best[0], *symbols[k + 2:]]
        return last

    def _patterns(self, usable: np.ndarray) -> None:
        """Usable pieces as bytes, blanks as spaces, in blocks of eight bytes for the binary search."""
        texts = [self.texts[m].replace("▁", " ").encode() for m in usable]
        self.pattern_piece, self.pattern_length = usable, np.array([len(t) for t in texts])
        self.blocks = -(-int(self.pattern_length.max()) // 8)
        padded = np.zeros((len(texts), 8 * self.blocks), np.uint8)
        for k, t in enumerate(texts):
            padded[k, :len(t)] = np.frombuffer(t, np.uint8)
        self.low = padded.view(">u8").astype(np.uint64)
        open_bytes = np.arange(8 * self.blocks)[None, :] >= self.pattern_length[:, None]
        self.high = np.where(open_bytes, 255, padded).astype(np.uint8).view(">u8").astype(np.uint64)

    def may_follow(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """`lasting` with a memory of pairs met before: a table of fixed size, where the latest pair of a slot stays."""
        key = first * (self.count + 1) + second
        slot = (mix64(key.astype(np.uint64)) >> np.uint64(64 - MEMORY)).astype(np.int64)
        fine = self._met_fine[slot]
        new = np.flatnonzero(self._met[slot] != key)
        if len(new):
            pairs, back = np.unique(key[new], return_inverse=True)
            found = self.lasting(pairs // (self.count + 1), pairs % (self.count + 1))
            fine[new] = found[back]
            self._met[slot[new]], self._met_fine[slot[new]] = key[new], fine[new]
        return fine

    def lasting(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For arrays of pieces: would merging the text of both leave them as they are?

        Their last merges are undone, the later one first. If the two parts that then meet at the border make a pair that
        merges before what was undone, the border would not have lasted.
        """
        n = len(first)
        fine, at = np.ones(n, bool), np.arange(n)
        first, second = first.copy(), second.copy()
        limit = np.full(n, np.iinfo(np.int64).max)
        while len(at):
            key = first * (self.count + 1) + second
            place = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
            broken = (self._pairs[place] == key) & (self._merged[place] < limit)
            fine[at[broken]] = False
            # Undo the later merge; of equal ones the right one, since merging goes from the left.
            inner_first, inner_second = self.right[first], self.left[second]
            whole_first, whole_second = inner_first == first, inner_second == second
            undo_first = np.where(first > second, ~whole_first, whole_second) & ~whole_first
            done = whole_first & whole_second
            limit = np.where(undo_first, first, second + 1)
            first, second = np.where(undo_first, inner_first, first), np.where(undo_first, second, inner_second)
            go_on = ~(broken | done)
            at, first, second, limit = at[go_on], first[go_on], second[go_on], limit[go_on]
        return fine

    # --- matching ----------------------------------------------------------------------------

    def occurrences(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, pattern number) of every piece in the indexed text."""
        padded = np.concatenate([data, np.zeros(8 * self.blocks + 8, np.uint8)])
        n = len(data)
        heads = np.zeros(n + 8 * self.blocks, np.uint64)  # the next eight bytes of each position, as one number
        for k in range(8):
            heads = (heads << np.uint64(8)) | padded[k:k + len(heads)]
        order = np.argsort(heads[:n], kind="stable")
        first = heads[:n][order]
        alike = first[1:] == first[:-1]
        tied = np.flatnonzero(np.append(alike, False) | np.insert(alike, 0, False))
        if self.blocks > 1 and len(tied):  # the next blocks decide, inside the places of equal first blocks
            among = order[tied]
            order[tied] = among[np.lexsort([heads[8 * b + among] for b in range(self.blocks - 1, -1, -1)])]
        begin = np.searchsorted(first, self.low[:, 0], side="left")
        end = np.searchsorted(first, self.high[:, 0], side="right")
        for b in range(1, self.blocks):
            longer = np.flatnonzero((self.pattern_length > 8 * b) & (end > begin))
            if not len(longer):
                break
            block = heads[8 * b:8 * b + n]
            begin[longer], end[longer] = (
                _bisect(block, order, begin[longer], end[longer], self.low[longer, b], False),
                _bisect(block, order, begin[longer], end[longer], self.high[longer, b], True))
        count = np.maximum(0, end - begin)
        found = np.repeat(np.arange(len(count)), count)
        return order[np.repeat(begin, count) + ragged_arange(count)], found

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (blanks as spaces), as little-endian unsigned 32-bit sequences."""
        text = b"\0".join(words) + b"\0"  # no piece holds a zero byte, so none crosses a border
        data = np.frombuffer(text, np.uint8)
        starts, which = self.occurrences(data)
        ends, tokens = starts + self.pattern_length[which], self.pattern_piece[which]
        # Characters that are no piece of their own stand for their bytes.
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        size = np.diff(np.append(lead, len(data)))
        covered = np.zeros(len(data), bool)
        char_end = np.zeros(len(data) + 1, np.int64)
        char_end[lead] = lead + size
        covered[starts[ends == char_end[starts]]] = True
        lengths = np.array([len(w) for w in words])
        word_start = np.cumsum(lengths + 1) - lengths - 1
        border = np.zeros(len(data), bool)
        border[word_start + lengths] = True
        unknown = lead[~covered[lead] & ~border[lead]]
        starts, ends = np.concatenate([starts, unknown]), np.concatenate([ends, char_end[unknown]])
        tokens = np.concatenate([tokens, np.full(len(unknown), self.count)])
        # Relax the edges in the order of their ends inside the words.
        word = np.searchsorted(word_start, starts, side="right") - 1
        reach = ends - word_start[word]
        by_end = np.argsort(reach, kind="stable")
        starts, ends, tokens, reach = starts[by_end], ends[by_end], tokens[by_end], reach[by_end]
        cuts = np.flatnonzero(np.diff(np.concatenate([[-1], reach, [-1]])))
        last, back = np.full(len(data) + 1, -1), np.full(len(data) + 1, -1)
        first = np.zeros(len(data) + 1, bool)
        first[word_start] = True
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s, e, t = starts[a:b], ends[a:b], tokens[a:b]
            begins, before = first[s], last[s]
            fine = begins.copy()
            rest = np.flatnonzero(~begins & (before >= 0))
            fine[rest] = self.may_follow(before[rest], t[rest])
            last[e[fine]], back[e[fine]] = t[fine], s[fine]
        return self._paths(data, word_start, lengths, last, back)

    def _paths(self, data: np.ndarray, begin: np.ndarray, lengths: np.ndarray, last: np.ndarray, back: np.ndarray) -> list[bytes]:
        """Follow the paths from the words' ends, all words at once, then put the tokens in order."""
        word, at = np.arange(len(begin)), begin + lengths
        words, places, tokens = [], [], []
        while len(at):
            words.append(word)
            places.append(back[at])
            tokens.append(last[at])
            word, at = word[back[at] > begin[word]], back[at][back[at] > begin[word]]
        word, place, token = np.concatenate(words), np.concatenate(places), np.concatenate(tokens)
        order = np.argsort(place, kind="stable")
        word, place, token = word[order], place[order], token[order]
        unknown = token == self.count
        width = np.ones(len(token), np.int64)
        ends = np.append(place[1:], 0)
        last_of_word = np.append(word[1:] != word[:-1], True)
        ends[last_of_word] = (begin + lengths)[word[last_of_word]]
        width[unknown] = (ends - place)[unknown]
        out = np.repeat(self.ids[np.minimum(token, self.count - 1)], width)
        spread = np.repeat(unknown, width)
        out[spread] = self.bytes_ids[data[(np.repeat(place, width) + ragged_arange(width))[spread]]]
        total = np.bincount(word, weights=width, minlength=len(begin)).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(total)]) * 4
        raw = out.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def decode(self, ids: bytes) -> bytes:
        """Text of an id sequence, without the dummy prefix."""
        table = self.decoded
        out = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return out[1:] if out.startswith(b" ") else out


def _bisect(block: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray, after: bool) -> np.ndarray:
    """Per range of the order, the first place whose block is not below (or, with `after`, is above) the value."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        here = block[order[np.minimum(middle, len(order) - 1)]]
        up = open_ & ((here <= value) if after else (here < value))
        low = np.where(up, middle + 1, low)
        high = np.where(open_ & ~up, middle, high)
    return low


class Encoder:
    """A model and the words it has encoded lately. The words belong to one task."""

    def __init__(self, path: str) -> None:
        self.model = piece_model(path)
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [WORDS.findall(b" " + t.replace(SPACE, b" ")) if t else [] for t in texts]
        known, old, missing = self._young, self._old, []
        for w in {w for words in split for w in words}.difference(known):
            if w in old:
                known[w] = old[w]
            else:
                missing.append(w)
        for part in bounded(missing, INDEXED):
            words = missing[part.start:part.stop]
            known.update(zip(words, self.model.encode_words(words), strict=True))
        out = [b"".join([known[w] for w in words]) for words in split]
        if len(known) > REMEMBERED:
            self._old, self._young = known, {}
        return out


@lru_cache(maxsize=1)
def piece_model(path: str) -> PieceModel:
    """A worker's model, for all its tasks."""
    return PieceModel(path)


def encode(docs: DataFrame, model_path: str, with_text: bool = False) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every row.

    `with_text` adds the text that the ids decode to, made in the same pass: a second Python stage would cost every task
    a second worker.
    """
    names = ["doc_id", "ids", "text"] if with_text else ["doc_id", "ids"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(model_path)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            for part in bounded(texts, CHUNK):
                found = own.encode([texts[i] or b"" for i in part])
                ids = [None if texts[i] is None else f for i, f in zip(part, found, strict=True)]
                columns = [batch.column(0).slice(part.start, len(part)), pa.array(ids, pa.binary())]
                if with_text:
                    columns.append(pa.array([None if i is None else own.model.decode(i) for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(over, "doc_id long, ids binary" + (", text binary" if with_text else ""))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """`encoded` (doc_id, ids) with the text that the ids stand for."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            texts = [None if not i.is_valid else model.decode(i.as_py()) for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(over, "doc_id long, ids binary, text binary")

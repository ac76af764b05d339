"""Best-fit packing of tokenized documents into sequences of bounded length.

Documents are tokenized once, in Arrow batches, and only their pieces' lengths travel on. Pieces are dealt out evenly
into groups of bounded size; each group is packed best fit first and then improved by swap-based local search:
documents are moved, exchanged one for one or two for one between underfull sequences whenever that raises the sum of
squared fills, until sequences become empty. That sum is a bounded integer, so the search ends.

Nulls and odd cases: a null or empty text has the end token only. A null doc_id is kept as it is. Repeated rows are
packed as often as they occur. An empty table gives an empty result. Further columns of the input are ignored. Texts of any
length are tokenized whole, part by part; what a task remembers of parts is bounded in bytes and goes with the task.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.sources.scratch import written

from .batches import bounded

#: Bytes of parts, with what a table needs for them, that a task remembers: two generations of so many each.
REMEMBERED = 24 << 20
#: Bytes of one entry beside its part and ids.
ENTRY = 200
#: Bytes of text whose pieces make one batch (a longer text stands alone).
CHUNK = 1 << 20
#: Pieces of one packing group.
GROUP = 20_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: How word_bpe tokenizers normalize texts and part them, as their files say it.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PARTING = [{"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
#: The same parts of lower-case Latin-1 bytes: letters, a digit, a contraction's end, marks. White space is in none; what
#: follows a part is matched with it, which is faster than to search for the next part.
PARTS = re.compile(rb"([a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|'(?:s|t|re|ve|m|ll|d)"
                   rb"|[^\t-\r \x85\xa0a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+)[\t-\r \x85\xa0]*")
WORDS = re.compile(r"[^ \t-\r]+")


class WordTokenizer:
    """Ids of a text, part by part: what the tokenizer parts texts into is encoded by itself, so parts may be remembered.

    Latin-1 texts are parted here as the tokenizer's file says and go to its model. Others are cut at ASCII white space
    only, and words beyond Latin-1 go to the library whole; so do all words of tokenizers that part texts in another way,
    which must part their tokens at white space. Ids are little-endian unsigned 32-bit sequences.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on every core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        special = self._tokenizer.get_added_tokens_decoder().values()
        self._parted_here = (_steps(self._tokenizer.normalizer, "normalizers") == _NORMALIZER
                             and _steps(self._tokenizer.pre_tokenizer, "pretokenizers") == _PARTING
                             and self._tokenizer.post_processor is None and all(t.content.startswith("<|") for t in special))
        #: Parts are bytes, words that are not parted here are strings.
        self._young: dict[bytes | str, bytes] = {}
        self._old: dict[bytes | str, bytes] = {}
        self._held = 0

    def ids(self, text: bytes) -> bytes:
        latin = self._latin(text)
        whole = self._ids(WORDS.findall(text.decode("utf-8", "replace")) if latin is None else PARTS.findall(latin))
        if self._held > REMEMBERED:
            self._old, self._young, self._held = self._young, {}, 0
        return whole

    def _ids(self, units: list[bytes] | list[str]) -> bytes:
        found = list(map(self._young.get, units))
        if None in found:
            for i in [i for i, ids in enumerate(found) if ids is None]:
                found[i] = self._unmet(units[i])
        return b"".join(found)

    def _unmet(self, unit: bytes | str) -> bytes:
        """Ids of a part or word that the young generation does not hold (or has met just now)."""
        if (ids := self._young.get(unit)) is None:
            if (ids := self._old.get(unit)) is None:
                ids = self._part(unit) if isinstance(unit, bytes) else self._word(unit)
            self._held += (len(unit) if isinstance(unit, bytes) else 4 * len(unit)) + len(ids) + ENTRY
            self._young[unit] = ids
        return ids

    def _latin(self, text: bytes) -> bytes | None:
        """`text` in lower case and Latin-1, whose letters have no other forms to compose; None if it cannot be parted here.

        Special tokens, which begin with `<|` and are matched before anything else, are left to the library.
        """
        if not self._parted_here or b"<|" in text:
            return None
        if text.isascii():
            return text.lower()
        try:
            return text.decode().encode("latin-1").decode("latin-1").lower().encode("latin-1")
        except UnicodeError:
            return None

    def _part(self, part: bytes) -> bytes:
        text = part.decode("latin-1")
        if not (text.isascii() and text.isprintable()):
            text = text.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self._model.tokenize(text)]).tobytes()

    def _word(self, word: str) -> bytes:
        if (latin := self._latin(word.encode())) is not None:
            return self._ids(PARTS.findall(latin))
        return array("I", self._tokenizer.encode(word, add_special_tokens=False).ids).tobytes()


def _steps(component: object, kind: str) -> list[dict]:
    """The steps of a tokenizer's normalizer or pre-tokenizer, as its file lists them."""
    return json.loads(component.__getstate__()).get(kind, []) if component else []


def _byte_letters() -> dict[int, str]:
    """How byte-level tokenizers write bytes: printable Latin-1 as itself, the others as letters from U+0100 on."""
    printable = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
    others = [c for c in range(256) if c not in set(printable)]
    return {c: chr(c) for c in printable} | {c: chr(256 + k) for k, c in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
                 with_ids: bool = False) -> DataFrame:
    """One row per piece: its place in its document, its length and its ids' CRC-32 (and the ids, if asked for)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, width = WordTokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t.as_py() or b"" for t in batch.column(1)]
            for part in bounded(texts, CHUNK):
                rows: list[tuple] = []
                for i in part:
                    whole = encode.ids(texts[i]) + end
                    for k, at in enumerate(range(0, len(whole), width)):
                        piece = whole[at:at + width]
                        rows.append((doc_ids[i], k, at // 4, len(piece) // 4, zlib.crc32(piece), piece))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][:6 if with_ids else 5]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)],
                                                 names=names[:len(kinds)])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(pieces, _PIECES + (", ids binary" if with_ids else ""))


def pack(pieces: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """`pieces` with sequence_id and offset. `pieces` should be a stored table: it is counted, then read again.

    A full piece is a sequence of its own. The others are dealt out by their place in the table, so no value of any
    column can make a group large.
    """
    rows = pieces.count()
    groups = max(1, -(-rows // group))
    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    placed = pieces.withColumn("_place", F.monotonically_increasing_id())
    whole = placed.where(F.col("length") >= capacity).select(
        *pieces.columns, (-1 - F.col("_place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def one_group(table: pa.Table) -> pa.Table:
        number = table["_group"][0].as_py()
        sequence, offset = pack_lengths(table["length"].to_numpy(), capacity)
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(sequence + (number << 32), pa.int64())
                                                            ).append_column("offset", pa.array(offset, pa.int64()))

    parts = placed.where(F.col("length") < capacity).select(
        *pieces.columns, F.pmod("_place", F.lit(groups)).alias("_group"))
    return whole.unionByName(parts.groupBy("_group").applyInArrow(one_group, schema))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
                   group: int = GROUP) -> DataFrame:
    """Tokenize, store the pieces in the shared scratch folder and pack them."""
    return pack(written(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity, group)


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length (1..capacity): best fit by falling length, then local search."""
    bins = best_fit(lengths, capacity)
    improve(bins, lengths, capacity)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, items in enumerate(b for b in bins if b):
        at = 0
        for i in items:
            sequence[i], offset[i] = number, at
            at += int(lengths[i])
    return sequence, offset


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Longest first, each into the fullest bin that has room. Bins are found by their room through a bit set."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> None:
    """Drain underfull bins, the least filled first, by moves and swaps that raise the sum of squared fills.

    Ends when a pass changes nothing, or when no fewer bins could hold the items.
    """
    fill = np.array([int(lengths[b].sum()) if b else 0 for b in bins], np.int64)
    fewest = -(-int(fill.sum()) // capacity)
    state = _Places(bins, lengths, fill, capacity)
    squares = -1
    while int((fill > 0).sum()) > fewest and (now := int((fill * fill).sum())) > squares:
        squares = now
        for b in np.argsort(fill, kind="stable").tolist():
            if 0 < fill[b] < capacity:
                state.drain(b)


class _Places:
    """Which item lies in which bin. Partners are looked for by length, so equal items are looked at once."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, fill: np.ndarray, capacity: int) -> None:
        self.bins, self.lengths, self.fill, self.capacity = bins, lengths, fill, capacity
        self.home = np.zeros(len(lengths), np.int64)
        for b, items in enumerate(bins):
            self.home[items] = b
        #: Contents that no exchange has helped since the last one: bins of the same lengths need no further look.
        self.stuck: set[tuple[int, ...]] = set()
        self._offers: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def drain(self, source: int) -> None:
        """Move items out of `source`, or exchange them for shorter ones, while the sum of squared fills rises."""
        while self.bins[source]:
            content = tuple(sorted(int(self.lengths[i]) for i in self.bins[source]))
            if content in self.stuck:
                return
            if not (self.move(source) or self.one_for_one(source) or self.two_for_one(source)):
                self.stuck.add(content)
                return

    def shift(self, i: int, to: int) -> None:
        here, size = self.home[i], int(self.lengths[i])
        self.bins[here].remove(i)
        self.bins[to].append(i)
        self.fill[here] -= size
        self.fill[to] += size
        self.home[i] = to
        self.stuck.clear()
        self._offers = None

    def by_length(self, source: int) -> dict[int, list[int]]:
        """Items of a bin by length, the longest first."""
        out: dict[int, list[int]] = {}
        for i in sorted(self.bins[source], key=lambda i: -self.lengths[i]):
            out.setdefault(int(self.lengths[i]), []).append(i)
        return out

    def gains(self, source: int, target: int, net: int) -> bool:
        """Does it raise the sum of squares to carry `net` from `source` to `target`?"""
        return net > 0 and net + int(self.fill[target]) - int(self.fill[source]) > 0

    def move(self, source: int) -> bool:
        room = np.where(self.fill > 0, self.capacity - self.fill, 0)
        room[source] = 0
        for size, items in self.by_length(source).items():
            fits = np.flatnonzero(room >= size)
            if len(fits):
                target = int(fits[np.argmin(room[fits])])
                if self.gains(source, target, size):
                    self.shift(items[0], target)
                    return True
        return False

    def offers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the items of bins with room: each different (length, room of the bin), and two items in different bins with it.

        Two, so that one is left where the other lies in the bin that asks.
        """
        if self._offers is None:
            room = (self.capacity - self.fill)[self.home]
            open_ = np.flatnonzero(room > 0)
            open_ = open_[np.lexsort((self.home[open_], room[open_], self.lengths[open_]))]
            key = self.lengths[open_] * (self.capacity + 1) + room[open_]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(key)) - 1
            self._offers = key[first], open_[first], open_[last]
        return self._offers

    def partner(self, source: int, size: int) -> tuple[int, int] | None:
        """The item elsewhere for which `size` from `source` is exchanged so that its bin ends fullest: room left, item."""
        key, first, last = self.offers()
        item = np.where(self.home[first] == source, last, first)
        net, room = size - key // (self.capacity + 1), key % (self.capacity + 1)
        fits = (net > 0) & (net <= room) & (self.home[item] != source)
        if not fits.any():
            return None
        left = np.where(fits, room - net, self.capacity + 1)
        best = int(np.argmin(left))
        return (int(left[best]), int(item[best])) if self.gains(source, int(self.home[item[best]]), int(net[best])) else None

    def one_for_one(self, source: int) -> bool:
        """The exchange that fills some other bin best."""
        best: tuple[int, int, int] | None = None
        for size, items in self.by_length(source).items():
            found = self.partner(source, size)
            if found and (best is None or found[0] < best[0]):
                best = (found[0], items[0], found[1])
        if best is None:
            return False
        _, i, j = best
        target = int(self.home[j])
        self.shift(j, source)
        self.shift(i, target)
        return True

    def two_for_one(self, source: int) -> bool:
        """Two items of `source` for one longer item's place elsewhere; pairs of one sum are looked at once."""
        own, seen = self.by_length(source), set()
        for a in own:
            for b in own:
                if b <= a and (a != b or len(own[a]) > 1) and a + b not in seen:
                    seen.add(a + b)
                    found = self.partner(source, a + b)
                    if found:
                        first, second = own[a][0], own[b][-1]
                        target = int(self.home[found[1]])
                        self.shift(found[1], source)
                        self.shift(first, target)
                        self.shift(second, target)
                        return True
        return False

"""Keyed digests and the arithmetic on them, as Catalyst expressions.

A digest travels as 64 lower-case hex characters. Everything here stays on the
JVM side.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import re
import secrets
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_NAMESPACE = "veilwright"
MAX_ATTEMPTS = 8

_POLICY_HASH = re.compile(r"sha256:[0-9a-f]{64}")
_BLOCK = 64
_LONG_BITS = 63


@dataclass(frozen=True)
class Keyring:
    """The run's 32-byte key, its reference day and its retry label."""

    key: bytes
    reference_date: dt.date
    namespace: str = DEFAULT_NAMESPACE

    @classmethod
    def derive(
        cls,
        seed: bytes,
        policy_hash: str,
        reference_time: dt.date | dt.datetime,
        namespace: str = DEFAULT_NAMESPACE,
    ) -> "Keyring":
        if len(seed) < 32:
            raise ValueError("the seed needs 32 bytes or more")
        if not _POLICY_HASH.fullmatch(policy_hash):
            raise ValueError("the policy hash must read sha256:<64 hex digits>")
        if reference_time is None:
            raise ValueError("a reference day is needed")
        if isinstance(reference_time, dt.datetime):
            if reference_time.tzinfo is not None:
                reference_time = reference_time.astimezone(dt.timezone.utc)
            reference_time = reference_time.date()
        label = f"{namespace}/v1/{policy_hash}".encode()
        return cls(hmac.new(seed, label, hashlib.sha256).digest(), reference_time, namespace)

    @property
    def retry_label(self) -> bytes:
        return f"{self.namespace}/unique-retry/".encode()

    def pads(self) -> tuple[bytes, bytes]:
        """HMAC's inner and outer 64-byte key blocks."""
        block = self.key.ljust(_BLOCK, b"\0")
        return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def fresh_seed() -> bytes:
    """Seed of one PerRun run."""
    return secrets.token_bytes(32)


def keyed_digest(keyring: Keyring, payload: Column) -> Column:
    """HMAC-SHA256 of a binary payload, as hex. NULL in, NULL out."""
    inner, outer = keyring.pads()
    first = F.unhex(F.sha2(F.concat(F.lit(inner), payload), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def consistent_payload(strategy: str, normalized: Column) -> Column:
    """Equal normalized inputs under one strategy share a payload in every table."""
    return F.concat(F.lit(strategy + "\x1f"), normalized).cast("binary")


def row_payload(database: str, table: str, pk_json: Column, column: str) -> Column:
    """JSON array of the row identity; `pk_json` is JSON text that is already escaped for a JSON string."""
    if not (database and table and column):
        raise ValueError("a row identity needs a database, a table and a column")
    return F.concat(F.lit(f'["{database}","{table}","'), pk_json, F.lit(f'","{column}"]')).cast("binary")


def retry_digest(keyring: Keyring, digest: Column, retry: Column) -> Column:
    """Re-derive a digest for UNIQUE attempt 1..7; attempt 0 is the digest itself."""
    counter = F.unhex(F.lpad(F.hex(retry.cast("bigint")), 2, "0"))
    again = keyed_digest(keyring, F.concat(F.lit(keyring.retry_label), F.unhex(digest), counter))
    return F.when(retry > 0, again).otherwise(digest)


def hex_int(digest: Column, start: int, width: int) -> Column:
    """`width` (<= 15) hex characters from 1-based `start`, as bigint."""
    return F.conv(F.substring(digest, start, width), 16, 10).cast("bigint")


def pick(digest: Column, slot: int, size: int) -> Column:
    """Index 0..size-1 from the slot-th of eight 32-bit digest slices."""
    return hex_int(digest, 1 + 8 * slot, 8) % F.lit(size)


def stretch(digest: Column, blocks: int) -> Column:
    """`blocks` * 64 hex characters: the digest, then its counter-mode successors."""
    raw = F.unhex(digest)
    if blocks <= 4:
        return F.concat(digest, *[F.sha2(F.concat(raw, F.lit(bytes([0, 0, 0, i]))), 256) for i in range(1, blocks)])
    tail = F.transform(
        F.sequence(F.lit(1), F.lit(blocks - 1)),
        lambda i: F.sha2(F.concat(raw, F.unhex(F.lpad(F.hex(i.cast("bigint")), 8, "0"))), 256),
    )
    return F.concat(digest, F.array_join(tail, ""))


# --- 256-bit big-endian digest modulo m -------------------------------------------------


def fits_long(modulus: int) -> bool:
    """Whether bigint arithmetic is enough for this modulus."""
    twos, odd = _split_modulus(modulus)
    return modulus <= 2**62 and twos <= 31 + 31 * (odd == 1) and odd.bit_length() <= _LONG_BITS - 4


def _split_modulus(modulus: int) -> tuple[int, int]:
    """modulus = 2**twos * odd."""
    twos = (modulus & -modulus).bit_length() - 1
    return twos, modulus >> twos


def digest_words(digest: Column) -> list[Column]:
    """The digest as four 64-bit patterns in bigints. Negative target base: signed result."""
    return [F.conv(F.substring(digest, start, 16), 16, -10).cast("bigint") for start in (1, 17, 33, 49)]


def odd_residue(words: list[Column], modulus: int) -> Column:
    """The words, read as one integer, modulo the odd part of `modulus`.

    Horner steps take as many bits at a time as leave a product inside a bigint.
    """
    _, odd = _split_modulus(modulus)
    if odd == 1:
        return F.lit(0).cast("bigint")
    step = _LONG_BITS - odd.bit_length()
    value = None
    for word in words:
        left = 64
        while left:
            bits = min(step, left)
            left -= bits
            piece = F.shiftrightunsigned(word, left) if left else word
            if left + bits < 64:
                piece = piece.bitwiseAND(F.lit((1 << bits) - 1))
            value = piece if value is None else value * F.lit(1 << bits) + piece
            value = value % F.lit(odd)
    return value


def join_residue(words: list[Column], residue: Column, modulus: int) -> Column:
    """Digest mod `modulus` from its odd residue and its low bits (Chinese remainder theorem)."""
    twos, odd = _split_modulus(modulus)
    if twos == 0:
        return residue
    size = 1 << twos
    low = words[-1].bitwiseAND(F.lit(size - 1))
    if odd == 1:
        return low
    # pmod keeps the difference non-negative before it meets the inverse.
    factor = (F.pmod(low - residue, F.lit(size)) * F.lit(pow(odd, -1, size))) % F.lit(size)
    return residue + F.lit(odd) * factor


def wide_mod(digest: Column, modulus: int) -> Column:
    """Digest mod a modulus of up to 33 digits that no bigint steps fit, as decimal text.

    In `decimal(38,0)`, by steps of as many hex digits as keep every product inside. Powers of ten have `low_digits`.
    """
    if modulus == 2**64:
        return F.conv(F.substring(digest, 49, 16), 16, 10)
    if modulus > 10**33:
        raise ValueError("only powers of ten may have more than 33 digits")
    whole = "decimal(38,0)"
    size, value, width = F.lit(str(modulus)).cast(whole), None, min(12, (126 - modulus.bit_length()) // 4)
    for start in range(1, 65, width):
        width = min(width, 65 - start)
        piece = hex_int(digest, start, width).cast("decimal(15,0)")
        if value is not None:
            piece = (value * F.lit(16**width).cast("decimal(15,0)") + piece).cast(whole)
        value = (piece % size).cast(whole)
    return value.cast("string")


# --- the last decimal places of a digest --------------------------------------------------

#: Places of one limb: 16 products of 16 bits and a limb, and a carry, stay inside a bigint.
PLACES = 9


def low_digits(places: int) -> list[Callable[[Column, list[Column]], list[Column]]]:
    """Projections that end in the digest modulo 10 ** places as text of that many places, in bigints only.

    The digest is the sum of its sixteen 16-bit pieces, each times a power of two. Those powers, written in limbs of nine
    places, are constants, so every limb of the sum is sixteen products; carries then go from limb to limb. Each projection
    takes the digest and the columns of the one before. The products are an array's, not columns: generated code of that
    many columns would be too long for the JVM's compiler, and run interpreted with all that is fused to it.
    """
    limbs = -(-places // PLACES)
    base = 10**PLACES
    powers = [1 << (16 * (15 - i)) for i in range(16)]
    constants = [[power // base**number % base for power in powers] for number in range(limbs)]

    def pieces(digest: Column, words: list[Column]) -> list[Column]:
        return [F.array(*[F.shiftrightunsigned(words[i // 4], 48 - 16 * (i % 4)).bitwiseAND(F.lit(65535)) for i in range(16)])]

    def products(digest: Column, before: list[Column]) -> list[Column]:
        table = F.array(*[F.array(*[F.lit(c).cast("bigint") for c in row]) for row in constants])
        return [F.transform(table, lambda row: F.aggregate(
            F.zip_with(before[0], row, lambda piece, power: piece * power), F.lit(0).cast("bigint"), lambda total, term: total + term))]

    def apart(digest: Column, before: list[Column]) -> list[Column]:
        return [before[0][number] for number in range(limbs)]

    def carry(number: int):
        def projection(digest: Column, before: list[Column]) -> list[Column]:
            here = before[number]
            if number + 1 == limbs:
                return [*before[:number], here % F.lit(base)]
            onward = before[number + 1] + F.call_function("div", here, F.lit(base))
            return [*before[:number], here % F.lit(base), onward, *before[number + 2:]]

        return projection

    def text(digest: Column, before: list[Column]) -> list[Column]:
        first = places - PLACES * (limbs - 1)
        head = F.lpad((before[-1] % F.lit(10**first)).cast("string"), first, "0")
        return [F.concat(head, *[F.lpad(r.cast("string"), PLACES, "0") for r in reversed(before[:-1])])]

    return [lambda digest, before: digest_words(digest), pieces, products, apart, *[carry(n) for n in range(limbs)], text]


def with_low_digits(df: DataFrame, digest: str, places: int, name: str) -> DataFrame:
    """`df` with a column: the hex digest in `digest` modulo 10 ** places, as text of that many places."""
    columns: list[Column] = []
    kept, staged = df.columns, df
    for level, projection in enumerate(low_digits(places)):
        labels = {f"__{name}_{level}_{i}": c for i, c in enumerate(projection(F.col(digest), columns))}
        staged = staged.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(label) for label, c in labels.items()])
        columns = [F.col(label) for label in labels]
    return staged.select(*[F.col(f"`{c}`") for c in kept], columns[0].alias(name))


def digest_mod(digest: Column, modulus: int) -> Column:
    """Digest mod `modulus`, in one expression: bigint where that is enough, else decimal text.

    `transform` projects the words, the residue and the result one after the other instead,
    so that none of them is computed twice.
    """
    if not fits_long(modulus):
        return wide_mod(digest, modulus)
    words = digest_words(digest)
    return join_residue(words, odd_residue(words, modulus), modulus)

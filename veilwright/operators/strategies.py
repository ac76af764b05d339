"""The 29 replacement strategies as Catalyst expressions over a keyed digest.

`stages` lists the projections worth making once between digest and formatting;
`generated` turns the digest and the last stage into the replacement text.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PolicyError
from ..functions import corpora
from ..functions.digest import (
    Keyring, digest_words, fits_long, hex_int, join_residue, low_digits, odd_residue, pick, stretch, wide_mod,
)
from ..plans.rules import Rule

# Ranges that are not public unicast, in address order.
RESERVED_IPV4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
ALPHABETS = {
    "Mixed": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "Upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "Lower": "abcdefghijklmnopqrstuvwxyz0123456789",
}
_CHARS_PER_BLOCK = 16
# A 256-bit digest has at most 78 decimal digits; longer results are leading zeros.
_DIGEST_DIGITS = 78
_UNROLLED_CHARS = 32


def choices(words: list[str]) -> Column:
    """A literal array: the split of a literal folds to a constant once per query."""
    return F.split(F.lit("|".join(words)), "[|]")


def word(digest: Column, slot: int, words: list[str]) -> Column:
    return F.element_at(choices(words), (pick(digest, slot, len(words)) + 1).cast("int"))


def modulus(rule: Rule, keyring: Keyring) -> int | None:
    """What the digest is reduced by, for the numeric strategies."""
    p = rule.params
    if rule.strategy == "date":
        start, stop = date_bounds(rule, keyring)
        days = (stop - start).days
        return days * 86400 + 1 if p["format"] == "datetime" else days + 1
    return {
        "phone": lambda: 10 ** p["digits"],
        "digits": lambda: 10 ** min(p["length"], _DIGEST_DIGITS),
        "vatId": lambda: 10**9,
        "iban": lambda: 10**18,
        "number": lambda: p["max"] - p["min"] + 1,
    }.get(rule.strategy, lambda: None)()


def stages(rule: Rule, keyring: Keyring) -> list[Callable[[Column, list[Column]], list[Column]]]:
    """Projections between the digest and the formatted value.

    Each takes the digest and the columns of the stage before. Values that a later step
    uses more than once get a stage of their own, so Catalyst computes them once.
    """
    size = modulus(rule, keyring)
    if rule.strategy == "digits" and not fits_long(size):
        return low_digits(min(rule.params["length"], _DIGEST_DIGITS))
    if size is not None and not fits_long(size):
        return [lambda h, before: [wide_mod(h, size)]]
    if size is not None:
        return [
            lambda h, before: digest_words(h),
            lambda h, words: [odd_residue(words, size), words[-1]],
            lambda h, made: [join_residue([made[1]], made[0], size)],
        ]
    if rule.strategy == "alphanumeric":
        return [lambda h, before: [stretch(h, -(-rule.params["length"] // _CHARS_PER_BLOCK))]]
    if rule.strategy == "text":
        return [lambda h, before: [stretch(h, rule.params["sentences"])]]
    return []


def generated(rule: Rule, text: Column, digest: Column, extra: list[Column], keyring: Keyring) -> Column:
    """Replacement text for one value, given the last stage's columns.

    Keep/Generate handling is the caller's.
    """
    return _GENERATORS[rule.strategy](rule, text, digest, extra, keyring)


# --- words ------------------------------------------------------------------------------


def _from_list(words: list[str]):
    return lambda rule, text, h, extra, keyring: word(h, 0, words)


def _first_last(h: Column) -> tuple[Column, Column]:
    return word(h, 0, corpora.FIRST_NAMES), word(h, 1, corpora.LAST_NAMES)


def _full_name(rule, text, h, extra, keyring):
    return F.concat_ws(" ", *_first_last(h))


def _job_title(rule, text, h, extra, keyring):
    return F.concat_ws(
        " ", word(h, 0, corpora.JOB_LEVELS), word(h, 1, corpora.JOB_FIELDS), word(h, 2, corpora.JOB_ROLES)
    )


def _street(h: Column) -> Column:
    number = (pick(h, 0, 9900) + 100).cast("string")
    return F.concat_ws(" ", number, word(h, 1, corpora.STREET_STEMS), word(h, 2, corpora.STREET_SUFFIXES))


def _city_name(h: Column, slot: int) -> Column:
    return F.concat(word(h, slot, corpora.CITY_STEMS), word(h, slot + 1, corpora.CITY_ENDINGS))


def _zip(h: Column, slot: int) -> Column:
    return F.lpad(pick(h, slot, 100000).cast("string"), 5, "0")


def _address(rule, text, h, extra, keyring):
    return F.concat(
        _street(h), F.lit(", "), _city_name(h, 3), F.lit(", "), word(h, 5, corpora.STATES), F.lit(" "), _zip(h, 6)
    )


def _company(rule, text, h, extra, keyring):
    return F.concat_ws(
        " ", word(h, 0, corpora.COMPANY_STEMS), word(h, 1, corpora.COMPANY_FIELDS), word(h, 2, corpora.COMPANY_SUFFIXES)
    )


def _host(h: Column, slot: int) -> Column:
    stem = F.lower(F.concat(word(h, slot, corpora.COMPANY_STEMS), word(h, slot + 1, corpora.COMPANY_FIELDS)))
    return F.concat(stem, F.lit("."), word(h, slot + 2, corpora.DOMAIN_SUFFIXES))


def _url(rule, text, h, extra, keyring):
    return F.concat(F.lit("https://www."), _host(h, 0), F.lit("/"), word(h, 3, corpora.PROSE_WORDS))


def _email(rule, text, h, extra, keyring):
    # Local part: at most 51 characters, then a dash and 12 hex characters of the digest.
    local = F.lower(F.concat_ws(".", *_first_last(h)))
    domain = F.lit(rule.params["domain"]) if rule.params["domain"] else _host(h, 5)
    return F.concat(F.substring(local, 1, 51), F.lit("-"), F.substring(h, 33, 12), F.lit("@"), domain)


def _text(rule, text, h, extra, keyring):
    stream, sentences = extra[0], rule.params["sentences"]

    def sentence(start: Column) -> Column:
        lexicon = choices(corpora.PROSE_WORDS)
        piece = [F.conv(F.substr(stream, start + 4 * i, F.lit(4)), 16, 10).cast("int") for i in range(13)]
        drawn = [F.element_at(lexicon, p % len(corpora.PROSE_WORDS) + 1) for p in piece[1:]]
        body = F.array_join(F.slice(F.array(*drawn), F.lit(1), piece[0] % 9 + 4), " ")
        return F.concat(F.upper(F.substring(body, 1, 1)), F.substr(body, F.lit(2)), F.lit("."))

    if sentences == 1:
        prose = sentence(F.lit(1))
    else:
        prose = F.array_join(
            F.transform(F.sequence(F.lit(0), F.lit(sentences - 1)), lambda i: sentence(i * 64 + 1)), " "
        )
    return F.substring(prose, 1, rule.params["maxLength"])


# --- numbers and identifiers ------------------------------------------------------------


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _phone(rule, text, h, extra, keyring):
    return _padded(extra[0], rule.params["digits"])


def _digits(rule, text, h, extra, keyring):
    return _padded(extra[0], rule.params["length"])


def _vat_id(rule, text, h, extra, keyring):
    return F.concat(F.lit(rule.params["country"]), _padded(extra[0], 9))


def _iban(rule, text, h, extra, keyring):
    account = extra[0]
    # account * 10^6 + 131400 modulo 97, kept inside a bigint by reducing the account first.
    check = F.lit(98) - ((account % 97) * (10**6 % 97) + 131400) % 97
    return F.concat(F.lit("DE"), _padded(check, 2), _padded(account, 18))


def _number(rule, text, h, extra, keyring):
    low = rule.params["min"]
    if fits_long(modulus(rule, keyring)):
        return (extra[0] + F.lit(low)).cast("bigint")
    wide = extra[0].cast("decimal(38,0)") + F.lit(low).cast("decimal(38,0)")
    return wide.cast("bigint")


def date_bounds(rule: Rule, keyring: Keyring) -> tuple[dt.date, dt.date]:
    start = dt.date.fromisoformat(rule.params["from"])
    stop = dt.date.fromisoformat(rule.params["to"]) if rule.params["to"] else keyring.reference_date
    if stop < start:
        raise PolicyError("date range ends before it starts")
    return start, stop


def _date(rule, text, h, extra, keyring):
    start, _ = date_bounds(rule, keyring)
    if rule.params["format"] == "date":
        return F.date_format(F.date_add(F.lit(start), extra[0].cast("int")), "yyyy-MM-dd")
    moment = F.timestamp_add("SECOND", extra[0], F.lit(start).cast("timestamp_ntz"))
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def _reserved_ranges() -> list[tuple[int, int]]:
    ranges = []
    for prefix in RESERVED_IPV4:
        address, bits = prefix.split("/")
        base = 0
        for octet in address.split("."):
            base = base * 256 + int(octet)
        ranges.append((base, 1 << (32 - int(bits))))
    return ranges


def public_ipv4_steps() -> tuple[int, list[tuple[int, int]]]:
    """Count of public addresses, and (rank, shift): ranks from `rank` on move up by `shift`."""
    steps, skipped = [], 0
    for base, size in _reserved_ranges():
        rank = base - skipped
        skipped += size
        steps.append((rank, skipped))
    return 2**32 - skipped, steps


def _ipv4_public(rule, text, h, extra, keyring):
    # The rank-th public address: nothing is drawn and rejected, so nothing can run out.
    count, steps = public_ipv4_steps()
    rank = hex_int(h, 1, 15) % F.lit(count)
    shift = F.lit(0)
    for threshold, skipped in steps:
        shift = F.when(rank >= threshold, F.lit(skipped)).otherwise(shift)
    address = rank + shift
    return F.concat_ws(
        ".", *[F.shiftright(address, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    )


def _uuid(rule, text, h, extra, keyring):
    variant = F.element_at(choices(list("89ab")), (hex_int(h, 17, 1) % 4 + 1).cast("int"))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def _alphanumeric(rule, text, h, extra, keyring):
    alphabet, length = ALPHABETS[rule.params["case"]], rule.params["length"]
    symbols = choices(list(alphabet))

    def symbol(start: Column) -> Column:
        drawn = F.conv(F.substr(extra[0], start, F.lit(4)), 16, 10).cast("int")
        return F.element_at(symbols, drawn % len(alphabet) + 1)

    if length <= _UNROLLED_CHARS:
        return F.concat(*[symbol(F.lit(1 + 4 * i)) for i in range(length)])
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: symbol(i * 4 + 1)), "")


def _hash(rule, text, h, extra, keyring):
    encoded = h if rule.params["encoding"] == "hex" else F.base64(F.unhex(h))
    return F.substring(encoded, 1, rule.params["length"])


# --- digest-free ------------------------------------------------------------------------


def _constant(rule, text, h, extra, keyring):
    if rule.constant is None:
        raise ValueError("constant value has not been resolved")
    return F.lit(rule.constant)


def _mask(rule, text, h, extra, keyring):
    prefix, suffix = rule.params["keepPrefix"], rule.params["keepSuffix"]
    hidden = F.char_length(text) - F.lit(prefix + suffix)
    tail = F.substr(text, F.char_length(text) - F.lit(suffix - 1)) if suffix else F.lit("")
    masked = F.concat(
        F.substring(text, 1, prefix), F.repeat(F.lit(rule.params["maskChar"]), F.greatest(hidden, F.lit(0))), tail
    )
    return F.when(hidden <= 0, text).otherwise(masked)


def _null(rule, text, h, extra, keyring):
    return F.lit(None).cast("string")


_GENERATORS = {
    "firstName": _from_list(corpora.FIRST_NAMES),
    "lastName": _from_list(corpora.LAST_NAMES),
    "fullName": _full_name,
    "jobTitle": _job_title,
    "email": _email,
    "phone": _phone,
    "date": _date,
    "address": _address,
    "streetAddress": lambda rule, text, h, extra, keyring: _street(h),
    "streetSuffix": _from_list(corpora.STREET_SUFFIXES),
    "city": lambda rule, text, h, extra, keyring: _city_name(h, 0),
    "postalCode": lambda rule, text, h, extra, keyring: _zip(h, 0),
    "state": _from_list(corpora.STATES),
    "country": _from_list(corpora.COUNTRIES),
    "company": _company,
    "companySuffix": _from_list(corpora.COMPANY_SUFFIXES),
    "vatId": _vat_id,
    "iban": _iban,
    "ipv4Public": _ipv4_public,
    "url": _url,
    "uuid": _uuid,
    "alphanumeric": _alphanumeric,
    "digits": _digits,
    "number": _number,
    "text": _text,
    "constant": _constant,
    "hash": _hash,
    "mask": _mask,
    "null": _null,
}

"""Value-to-text rules that decide what a digest is computed over."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The Unicode White_Space characters.
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Characters that normal form C may change, alone or with their neighbours: marks, conjoining Hangul, and characters
# that stand for others; also characters that are newer than the JVM's tables. Texts without them are in that form already.
_UNSETTLED = (
    r"[\p{M}\p{Cn}\u1100-\u11FF\u0340\u0341\u0343\u0344\u0374\u037E\u0387\u0958-\u095F\u09DC-\u09DF\u0A33-\u0A5E\u0B5C\u0B5D"
    r"\u0F43-\u0FB9\u1F71-\u1FFD\u2000\u2001\u2126\u212A\u212B\u2329\u232A\u2ADC\uF900-\uFAFF\uFB1D-\uFB4E"
    r"\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1D}]"
)


@F.pandas_udf(T.StringType())
def _nfc_arrow(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def nfc(text: Column) -> Column:
    """Unicode NFC; bytes that are no UTF-8 stay as they are.

    Spark has no function for it. Only values that may change go to Python, in Arrow batches; all others travel as
    NULL. The function is deterministic, so filters pass below it.
    """
    unsettled = F.when(~is_ascii(text) & F.is_valid_utf8(text), text)
    return F.coalesce(_nfc_arrow(F.when(unsettled.rlike(_UNSETTLED), text)), text)


def trim(text: Column) -> Column:
    """Without leading and trailing white space; only values that have some pay for the search.

    In bytes that are no UTF-8, a part of a character may look like white space: only ASCII blanks go.
    """
    blank, ascii_blank = F.lit(WHITE_SPACE), F.lit("".join(c for c in WHITE_SPACE if c < "\x80"))
    edges = F.contains(blank, F.substring(text, 1, 1)) | F.contains(blank, F.substring(text, -1, 1))
    return F.when(edges & F.is_valid_utf8(text), F.btrim(text, blank)).when(edges, F.btrim(text, ascii_blank)).otherwise(text)


def nfc_trim(text: Column) -> Column:
    return nfc(trim(text))


def input_text(column: Column, data_type: T.DataType) -> Column:
    """The text a strategy sees for a stored value."""
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return column.cast("string")
    if isinstance(data_type, T.BinaryType):
        return column.cast("string")  # the same bytes, valid UTF-8 or not
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return rfc3339(column, data_type)
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return float_text(column)
    return column.cast("string")


def rfc3339(column: Column, data_type: T.DataType) -> Column:
    """UTC, fraction without trailing zeros, `Z` suffix."""
    if isinstance(data_type, T.DateType):
        return F.concat(F.date_format(column, "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    if isinstance(data_type, T.TimestampType):
        zone = F.current_timezone()
        column = F.convert_timezone(zone, F.lit("UTC"), column.cast("timestamp_ntz"))
    text = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0*$", ""), F.lit("Z"))


def float_text(column: Column) -> Column:
    """Plain notation for exponents -4..20, else `d.de+XX`; no trailing `.0`."""
    java = column.cast("string")
    sign = F.when(java.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    body = F.ltrim(java, F.lit("-"))
    mantissa = F.regexp_replace(F.substring_index(body, "E", 1), r"\.0$", "")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    # Guarded: a CAST of the mantissa of a plain number must never be reached.
    power = F.when(body.contains("E"), F.substring_index(body, "E", -1)).cast("int")
    shift = power + 1
    padded = F.rpad(digits, F.greatest(shift, F.char_length(digits)), F.lit("0"))
    whole = F.substr(padded, F.lit(1), shift)
    fraction = F.substr(padded, shift + 1)
    plain = F.when(fraction == "", whole).otherwise(F.concat(whole, F.lit("."), fraction))
    exponent = F.concat(
        F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.abs(power) < 10, F.concat(F.lit("0"), F.abs(power).cast("string"))).otherwise(
            F.abs(power).cast("string")
        ),
    )
    special = (
        F.when(java == "Infinity", F.lit("+Inf")).when(java == "-Infinity", F.lit("-Inf")).when(java == "NaN", java)
    )
    text = (
        F.when(~body.contains("E"), mantissa)
        .when(power == -4, F.concat(F.lit("0.000"), digits))
        .when(power.between(0, 20), plain)
        .otherwise(F.concat(mantissa, exponent))
    )
    return F.coalesce(special, F.concat(sign, text))


def pk_json(columns: list[tuple[Column, T.DataType]]) -> Column:
    """JSON array text of a key, as it stands inside a JSON string.

    Integers stay bare; strings and binary are base64, times RFC 3339: only the quotes need an escape.
    """
    parts: list[Column] = [F.lit("[")]
    quote = F.lit('\\"')
    for position, (column, kind) in enumerate(columns):
        if position:
            parts.append(F.lit(","))
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
            parts.append(column.cast("string"))
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            parts.append(float_text(column))
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            parts += [quote, rfc3339(column, kind), quote]
        else:
            raw = column if isinstance(kind, T.BinaryType) else column.cast("string").cast("binary")
            # Spark's base64 has no line breaks to strip since 4.0 (chunking off by default).
            parts += [quote, F.base64(raw), quote]
    parts.append(F.lit("]"))
    return F.concat(*parts)

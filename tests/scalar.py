"""Per-value reference results in plain Python, for comparing with the Spark expressions."""

import base64
import hashlib
import hmac
import unicodedata

from veilwright.functions.text import WHITE_SPACE

ALPHA = {
    "Mixed": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "Upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "Lower": "abcdefghijklmnopqrstuvwxyz0123456789",
}


def digest(keyring, strategy, value=None, row=None, retry=0):
    if row is None:
        value = unicodedata.normalize("NFC", value.strip(WHITE_SPACE))
        if strategy == "email":
            value = value.lower()
        payload = f"{strategy}\x1f{value}"
    else:
        db, table, pk, column = row
        escaped = pk.replace("\\", "\\\\").replace('"', '\\"')
        payload = f'["{db}","{table}","{escaped}","{column}"]'
    h = hmac.new(keyring.key, payload.encode(), hashlib.sha256).digest()
    if retry:
        h = hmac.new(keyring.key, keyring.retry_label + h + bytes([retry]), hashlib.sha256).digest()
    return h


def digits(h, length):
    return str(int.from_bytes(h, "big") % 10**length).zfill(length)


def iban(h):
    bban = digits(h, 18)
    return f"DE{98 - int(bban + '131400') % 97:02d}{bban}"


def number(h, low, high):
    return low + int.from_bytes(h, "big") % (high - low + 1)


def hashed(h, encoding="hex", length=None):
    text = h.hex() if encoding == "hex" else base64.b64encode(h).decode()
    return text[:length]


def mask(text, prefix=0, suffix=0, char="*"):
    prefix, suffix = min(prefix, len(text)), min(suffix, len(text))
    if prefix + suffix >= len(text):
        return text
    return text[:prefix] + char * (len(text) - prefix - suffix) + text[len(text) - suffix:]

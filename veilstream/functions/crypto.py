"""Keyed hashes, checksums, entropy and key ranges as native Columns."""

from __future__ import annotations

import hashlib
import os
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: one less than the order of the curve secp256k1, the largest private key.
SECP256K1_LAST = "fffffffffffffffffffffffffffffffebaaedce6af48a03bbfd25e8cd0364140"
SECP256K1_FIRST = "0" * 63 + "1"
#: Weights and check characters of an 18-character identity number.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"
DEFAULT_PEPPER = "veil-default-pepper"


def pepper(variable: str = "VEIL_PEPPER") -> str:
    """The key for fingerprints: an environment variable of the driver, or a default with a warning."""
    if value := os.environ.get(variable):
        return value
    warnings.warn(f"{variable} isn't set; fingerprints use the default pepper", stacklevel=2)
    return DEFAULT_PEPPER


def hmac_pads(key: str) -> tuple[str, str]:
    """Hex of the inner and outer pad of HMAC-SHA256."""
    if not key.strip():
        raise ValueError("the pepper is blank")
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()


def hmac_sha256(value: Column, key: str) -> Column:
    """Hex of HMAC-SHA256 of the text's UTF-8 bytes."""
    inner, outer = hmac_pads(key)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(value, "UTF-8")), 256))), 256)


def fingerprint(value: Column, key: str, length: int = 8) -> Column:
    return F.substring(hmac_sha256(value, key), 1, length)


def double_sha256(hex_value: Column) -> Column:
    return F.sha2(F.unhex(F.sha2(F.unhex(hex_value), 256)), 256)


def shannon(text: Column) -> Column:
    """Bits a character of the text's own distribution; 0 for an empty text."""
    n = F.length(text)
    chars = F.filter(F.split(text, "", -1), lambda c: c != "")

    def bits(cs: Column) -> Column:
        of = lambda c: F.size(F.filter(cs, lambda x: x == c)).cast("double") / n
        return F.aggregate(F.transform(F.array_distinct(cs), of), F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return F.when(n > 0, F.get(F.transform(F.array(chars), bits), F.lit(0))).otherwise(F.lit(0.0))


def secp256k1_valid(hex64: Column) -> Column:
    """Whether 64 hex digits are a private key: at least 1, below the order. Equal widths compare as strings."""
    return F.lower(hex64).between(SECP256K1_FIRST, SECP256K1_LAST)


def id_card_valid(number: Column) -> Column:
    """Whether the 18th character is the check of the 17 digits before it."""
    total = F.lit(0)
    for i, w in enumerate(ID_WEIGHTS):
        total = total + F.substring(number, i + 1, 1).cast("int") * w
    return F.substring(F.lit(ID_CHECKS), 1, 11).substr(total % 11 + 1, F.lit(1)) == F.upper(F.substring(number, 18, 1))

"""Checks of encoded keys that need arithmetic on long integers: small helpers behind one Arrow UDF on candidates."""

from __future__ import annotations

import base64
import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alphabets.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Generator and end constants of Bech32 and Bech32m.
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BECH32_ENDS = {1: "bech32", 0x2BC830A3: "bech32m"}
#: What the version bytes of an extended key stand for.
EXTENDED_VERSIONS = {
    "0488ADE4": "private",
    "049D7878": "private",
    "04B2430C": "private",
    "04358394": "private",
    "044A4E28": "private",
    "045F18BC": "private",
    "0295B005": "private",
    "02AA7A99": "private",
    "024285B5": "private",
    "02575048": "private",
    "0488B21E": "public",
    "049D7CB2": "public",
    "04B24746": "public",
    "043587CF": "public",
    "044A5262": "public",
    "045F1CF6": "public",
    "0295B43F": "public",
    "02AA7ED3": "public",
    "024289EF": "public",
    "02575483": "public",
}


def base58_decode(text: str) -> bytes | None:
    value = 0
    for c in text:
        at = BASE58.find(c)
        if at < 0:
            return None
        value = value * 58 + at
    body = value.to_bytes((value.bit_length() + 7) // 8, "big")
    zeros = len(text) - len(text.lstrip("1"))
    if zeros == len(text) and text:
        body = b"\0"  # the number zero still has a byte of its own
    return b"\0" * zeros + body


def base58_encode(data: bytes) -> str:
    value, out = int.from_bytes(data, "big"), ""
    while value:
        value, at = divmod(value, 58)
        out = BASE58[at] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


def base58check_decode(text: str) -> bytes | None:
    data = base58_decode(text)
    if data is None or len(data) < 5:
        return None
    body, check = data[:-4], data[-4:]
    return body if hashlib.sha256(hashlib.sha256(body).digest()).digest()[:4] == check else None


def base58check_encode(body: bytes) -> str:
    return base58_encode(body + hashlib.sha256(hashlib.sha256(body).digest()).digest()[:4])


def _polymod(values: list[int]) -> int:
    check = 1
    for v in values:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(BECH32_GENERATOR):
            check ^= g if top >> i & 1 else 0
    return check


def _expanded(prefix: str) -> list[int]:
    return [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]


def bech32_decode(text: str) -> tuple[str, list[int], str] | None:
    """(prefix, 5-bit values without the check, kind) or None."""
    if not 8 <= len(text) <= 1000 or (text != text.lower() and text != text.upper()):
        return None
    prefix, one, data = text.lower().rpartition("1")
    if not one or not prefix or len(data) < 6 or any(c not in BECH32 for c in data) or any(not 33 <= ord(c) <= 126 for c in prefix):
        return None
    values = [BECH32.index(c) for c in data]
    kind = BECH32_ENDS.get(_polymod(_expanded(prefix) + values))
    return (prefix, values[:-6], kind) if kind else None


def bech32_encode(prefix: str, values: list[int], kind: str = "bech32") -> str:
    end = next(k for k, v in BECH32_ENDS.items() if v == kind)
    check = _polymod(_expanded(prefix) + values + [0] * 6) ^ end
    return prefix + "1" + "".join(BECH32[v] for v in values + [check >> 5 * (5 - i) & 31 for i in range(6)])


def convert_bits(values, width: int, to: int, pad: bool) -> list[int] | None:
    held = bits = 0
    out = []
    for v in values:
        if v < 0 or v >> width:
            return None
        held, bits = held << width | v, bits + width
        while bits >= to:
            bits -= to
            out.append(held >> bits & (1 << to) - 1)
    rest = held & (1 << bits) - 1
    if pad:
        return [*out, rest << to - bits] if bits else out
    return None if bits >= width or rest else out


def base32_decode(text: str) -> bytes | None:
    if any(c not in BASE32 for c in text):
        return None
    values = [BASE32.index(c) for c in text]
    return bytes(convert_bits(values, 5, 8, True)[: len(values) * 5 // 8])


def crc16_xmodem(data: bytes) -> int:
    crc = 0
    for b in data:
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def is_wif(token: str) -> bool:
    body = base58check_decode(token)
    return body is not None and body[0] in (0x80, 0xEF) and (len(body) == 33 or (len(body) == 34 and body[33] == 1))


def extended_key(token: str) -> str | None:
    body = base58check_decode(token)
    return EXTENDED_VERSIONS.get(body[:4].hex().upper()) if body else None


def is_sui_key(token: str) -> bool:
    found = bech32_decode(token)
    data = convert_bits(found[1], 5, 8, False) if found and found[0] == "suiprivkey" else None
    return data is not None and len(data) == 33 and data[0] <= 3


def stellar_seed(payload: bytes) -> str:
    """The seed of 32 bytes: version, payload and their CRC in base 32."""
    body = b"\x90" + payload
    return base64.b32encode(body + crc16_xmodem(body).to_bytes(2, "little")).decode().rstrip("=")


def is_stellar_seed(token: str) -> bool:
    data = base32_decode(token)
    return data is not None and len(data) == 35 and data[0] == 0x90 and crc16_xmodem(data[:33]) == int.from_bytes(data[33:], "little")


CHECKS = {"bitcoin-wif": lambda t: "private" if is_wif(t) else None, "extended-key": extended_key, "sui-privkey": lambda t: "private" if is_sui_key(t) else None, "stellar-seed": lambda t: "private" if is_stellar_seed(t) else None}


def verified(candidates: Column) -> Column:
    """array<struct<rule, value>> to array<string>: what each candidate is (private, public), or null.

    Only candidates reach Python, in Arrow batches: short tokens that a native regular expression has found.
    """

    @F.pandas_udf("array<string>")
    def check(rows: pd.Series) -> pd.Series:
        return rows.map(lambda xs: [CHECKS[x["rule"]](x["value"]) for x in xs])

    # non-deterministic to the optimiser: it must not be copied into a generator or a filter, where no UDF can run
    return check.asNondeterministic()(candidates)

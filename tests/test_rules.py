"""Rules on single texts: positives, wrong checksums, boundaries."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from veilstream.functions import codecs
from veilstream.functions.spans import FINDINGS
from veilstream.operators import mnemonics
from veilstream.plans import inspection
from veilstream.sources.wordlists import syllable_wordlist

SEED = b"\x90" + bytes(32)
CASES = [
    ("private key: 0x" + "0" * 63 + "1", [("PRIVATE_KEY_HEX", "CRITICAL")]),
    ("sha256 私钥: " + "0" * 63 + "1", [("PRIVATE_KEY_HEX", "CRITICAL")]),
    ("use ed25519-priv-0x" + "f" * 64, [("PRIVATE_KEY_HEX", "CRITICAL")]),
    ("tx_hash: 0x" + "1" * 64, []),
    ("value " + "f" * 64, []),
    ("wallet key " + "f" * 64, [("PRIVATE_KEY_HEX", "HIGH")]),
    ("key=" + codecs.base58check_encode(b"\x80" + bytes(32) + b"\x01"), [("PRIVATE_KEY_WIF", "CRITICAL")]),
    ("key=" + codecs.base58check_encode(b"\x00" + bytes(32)), []),
    ("5" * 51, []),
    (codecs.base58check_encode(bytes.fromhex("0488ADE4") + bytes(74)), [("EXTENDED_PRIVATE_KEY", "CRITICAL")]),
    (codecs.base58check_encode(bytes.fromhex("0488B21E") + bytes(74)), [("EXTENDED_PUBLIC_KEY", "HIGH")]),
    (codecs.base58check_encode(bytes.fromhex("12345678") + bytes(74)), []),
    ("[" + ",".join(["0"] * 64) + "] solana keypair", [("SOLANA_KEYPAIR", "CRITICAL")]),
    ("[" + ", ".join(["0"] * 64) + "]", [("SOLANA_KEYPAIR", "MEDIUM")]),
    ("[" + ",".join(["0"] * 32) + "]", []),
    ("[" + ",".join(["999"] + ["0"] * 63) + "]", []),
    (codecs.bech32_encode("suiprivkey", codecs.convert_bits(bytes(33), 8, 5, True)), [("SUI_PRIVKEY", "CRITICAL")]),
    (base64.b32encode(SEED + codecs.crc16_xmodem(SEED).to_bytes(2, "little")).decode(), [("STELLAR_SECRET_SEED", "CRITICAL")]),
    (base64.b32encode(SEED + b"\0\0").decode(), []),
    ('{"type":"PaymentSigningKeyShelley_ed25519","cborHex":"5820"}', [("CARDANO_SIGNING_KEY", "CRITICAL")]),
    ('{"type":"PaymentVerificationKey","cborHex":"5820"}', []),
    ('{"address":1,"crypto":{"cipher":1,"ciphertext":1,"kdf":1,"mac":1}}', [("KEYSTORE_JSON", "CRITICAL")]),
    ('{"crypto":{"cipher":1,"ciphertext":1,"kdf":1,"mac":1}}', []),
    ("-----BEGIN OPENSSH PRIVATE KEY-----", [("PEM_PRIVATE_KEY", "CRITICAL")]),
    ("-----BEGIN PUBLIC KEY-----", []),
    ("0x" + "1" * 64 + "//hard/soft///pass", [("PRIVATE_KEY_HEX", "MEDIUM"), ("BLOCKCHAIN_SUBSTRATE_SECRET_URI", "CRITICAL")]),
]


def test_key_rules(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r["doc_id"]: [(f["entity_type"], f["risk_level"]) for f in r["secrets"]] for r in inspection.detect(df).collect()}
    assert [got[i] for i in range(len(CASES))] == [e for _, e in CASES]


PII = [
    ("13800000000", ["pii-cn-phone"]),
    ("99138000000001234", []),
    ("test@example.com, user+tag@example.com", ["pii-email", "pii-email"]),
    ("11010119900307889X", ["pii-cn-id-card"]),
    ("110101199003078888", []),
    ("4111111111111111", ["pii-bank-card"]),
    ("4111111111111112", []),
    (None, []),
    ("", []),
]


def test_pii(spark):
    from veilstream.operators import rules as R

    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PII)], "doc_id long, text string")
    got = {r[0]: [f["rule_id"] for f in r[1]] for r in df.select("doc_id", R.pii(F.coalesce("text", F.lit(""))).cast(FINDINGS)).collect()}
    assert [got[i] for i in range(len(PII))] == [e for _, e in PII]


@pytest.mark.parametrize("text,kind", [("A12UEL5L", "bech32"), ("abcdef1qpzry9x8gf2tvdw0s3jn54khce6mua7lmqqqxw", "bech32"), ("A1LQFN3A", "bech32m"), ("A12UEL5X", None), ("A12uEL5L", None)])
def test_bech32(text, kind):
    found = codecs.bech32_decode(text)
    assert (found[2] if found else None) == kind


def test_base58_round_trip():
    for body in (b"\0\0\1\2", bytes(5), b"\xff" * 33):
        assert codecs.base58check_decode(codecs.base58check_encode(body)) == body
    assert codecs.base58_decode("0OIl") is None


def _phrase(words, entropy):
    bits = "".join(f"{b:08b}" for b in entropy) + f"{hashlib.sha256(entropy).digest()[0]:08b}"[: len(entropy) // 4]
    return " ".join(words[int(bits[i : i + 11], 2)] for i in range(0, len(bits), 11))


def test_mnemonics(spark):
    listed = syllable_wordlist(spark)
    words = [r["word"] for r in listed.orderBy("idx").collect()]
    good = _phrase(words, bytes(16))
    bad = " ".join(good.split()[:-1] + [words[999]])
    longer = _phrase(words, bytes(range(32)))
    df = spark.createDataFrame([(0, good), (1, bad), (2, "seed phrase " + bad), (3, "助记词：" + good.upper()), (4, longer), (5, None), (6, "plain words only")], "doc_id long, text string")
    got = {}
    for r in mnemonics.mnemonics(df, listed).collect():
        got.setdefault(r["id"], set()).add((r["n_words"], r["risk_level"]))
    assert got[0] == {(12, "CRITICAL")} and got[3] >= {(12, "CRITICAL")} and 1 not in got and got[2] == {(12, "HIGH")}
    assert (24, "CRITICAL") in got[4] and set(got) == {0, 2, 3, 4}

"""Detection rules: each maps a text Column to an array of findings.

A rule is a native regular expression that proposes spans, and a predicate that keeps those that hold. Rules whose
predicate needs a codec share one Arrow UDF over the proposed tokens (`codec_matches`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import codecs, crypto
from ..functions.spans import finding, has_context, let, no_findings, regex_spans

#: Terms whose presence near a candidate decides.
MNEMONIC_TERMS = ["mnemonic", "seed phrase", "recovery phrase", "助记词", "恢复词", "种子短语"]
KEY_TERMS = ["private key", "privkey", "privatekey", "secret key", "wallet key", "私钥", "秘钥", "钱包密钥"]
NOT_KEY_TERMS = ["tx_hash", "block_hash", "sha256", "merkle", "transactiondigest"]
SOLANA_TERMS = ["solana", "keypair", "id.json", "fromsecretkey", "secretkey", "secret key"]
CONTEXT, SOLANA_CONTEXT = 48, 64

#: Patterns of candidates.
AIP80 = "(?i)(ed25519|secp256k1)-priv-0x[0-9a-f]{64}"
HEX64 = "(?i)(?:0x)?[0-9a-f]{64}"
WIF = "(?<![1-9A-HJ-NP-Za-km-z])[1-9A-HJ-NP-Za-km-z]{51,52}(?![1-9A-HJ-NP-Za-km-z])"
EXTENDED = "[1-9A-HJ-NP-Za-km-z]{107,115}"
SOLANA = "\\[\\s*\\d{1,3}(?:\\s*,\\s*\\d{1,3}){10,}\\s*]"
SUI = "suiprivkey1[qpzry9x8gf2tvdw0s3jn54khce6mua7l]{55,65}"
STELLAR = "S[A-Z2-7]{55}"
PEM = "-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----(?:[\\s\\S]*?-----END (?:[A-Z0-9 ]+ )?PRIVATE KEY-----)?"
EVM_ADDRESS = "(?<![0-9A-Za-z])0x[0-9a-fA-F]{40,64}(?![0-9a-fA-F])"
BTC_ADDRESS = "(?<![1-9A-HJ-NP-Za-km-z])[13][1-9A-HJ-NP-Za-km-z]{25,34}(?![1-9A-HJ-NP-Za-km-z])"
EMAIL = "[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}"
CN_PHONE = "(?<![0-9])1[3-9][0-9]{9}(?![0-9])"
CN_ID = "(?<![0-9Xx])[1-9]\\d{5}(?:19|20)\\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\\d|3[01])\\d{3}[\\dXx](?![0-9Xx])"
BANK_CARD = "(?<![0-9])[0-9]{13,19}(?![0-9])"
#: Our own readings of publicly documented credential formats: rule, type, confidence, what every match holds, pattern.
CREDENTIALS = [
    ("credential-openai", "API_KEY", 0.9, "sk-", "(?<![0-9A-Za-z])sk-[A-Za-z0-9_\\-]*T3BlbkFJ[A-Za-z0-9_\\-]*"),
    ("credential-aws", "API_KEY", 0.95, "AKIA", "(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    ("credential-gcp", "API_KEY", 0.9, "AIza", "(?<![0-9A-Za-z])AIza[0-9A-Za-z_\\-]{35}(?![0-9A-Za-z])"),
    ("credential-github-pat", "API_KEY", 0.95, "ghp_", "(?<![0-9A-Za-z])ghp_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    ("credential-jwt", "JWT", 0.85, "ey", "(?<![0-9A-Za-z])ey[A-Za-z0-9_-]+\\.ey[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+"),
]
GENERIC_SECRET = "(?i)(?:api[_-]?key|secret|token)[\"']?\\s*[=:]\\s*[\"']?([A-Za-z0-9_\\-./+=]{16,})"
PASSWORD = "(?i)(?:password|passwd|pwd)[\"']?\\s*[=:]\\s*[\"']?(\\S+)"
MIN_ENTROPY = 3.5


CANDIDATES = "array<struct<rule:string,start:int,end:int,value:string>>"
#: Every encoded key holds as many letters and digits in a row, every address and every number of a person these.
KEY_RUN, ADDRESS_RUN, DIGIT_RUN = 50, 26, 11


def alnum_run(text: Column, n: int) -> Column:
    """Whether n letters and digits stand in a row. The pattern takes a text without any in one go, without backtracking."""
    return ~F.rlike(text, F.lit(f"^(?:[0-9A-Za-z]{{0,{n - 1}}}+[^0-9A-Za-z]++)*+[0-9A-Za-z]{{0,{n - 1}}}+\\z"))


def long_run(text: Column) -> Column:
    return alnum_run(text, KEY_RUN)


def gates(text: Column) -> Column:
    """What a text holds at all, as a struct: each rule family searches only texts that meet its gate.

    run: an alphanumeric run of an address; key: of an encoded key; digits: a digit run; named, password: words that
    stand before a secret; signing: the name of a key envelope.
    """

    def of(x: Column) -> Column:
        low, run = x["low"], x["run"]
        has = lambda word: F.contains(low, F.lit(word))
        assigned = F.contains(low, F.lit("=")) | F.contains(low, F.lit(":"))
        return F.struct(
            run.alias("run"), (run & long_run(text)).alias("key"), F.rlike(text, F.lit(f"[0-9]{{{DIGIT_RUN}}}")).alias("digits"),
            (assigned & (has("secret") | has("token") | (has("api") & has("key")))).alias("named"), (assigned & (has("password") | has("passwd") | has("pwd"))).alias("password"),
            (has("signingkey") & has("cborhex")).alias("signing"),
        )

    return let(F.struct(F.lower(text).alias("low"), alnum_run(text, ADDRESS_RUN).alias("run")), of)


def key_gates(text: Column, signing: bool = True) -> Column:
    """Those of `gates` that the key rules ask for; signing: whether key envelopes are sought."""
    low = F.lower(text)
    return F.struct(long_run(text).alias("key"), ((F.contains(low, F.lit("signingkey")) & F.contains(low, F.lit("cborhex"))) if signing else F.lit(False)).alias("signing"))


def _kept(spans: Column, test, make) -> Column:
    return F.transform(F.filter(spans, lambda s: F.coalesce(test(s), F.lit(False))), make)


def _inside(start: Column, spans: Column) -> Column:
    return F.exists(spans, lambda o: (start >= o["start"]) & (start < o["end"]))


def _overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (span["start"] < o["end"]) & (o["start"] < span["end"]))


def evm_private_key(text: Column, context_required: bool = False, gate: Column | None = None) -> Column:
    """64 hex digits as a key: by the words around them and the range of keys. AIP-80 forms are certain, and hide plain ones in them."""
    rule = "evm-privkey-hex"

    def plain(aip: Column) -> Column:
        spans = F.filter(regex_spans(text, HEX64), lambda s: ~_inside(s["start"], aip))

        def judged(s: Column) -> Column:
            valid = crypto.secp256k1_valid(F.right(s["value"], F.lit(64)))
            yes = has_context(text, s["start"], s["end"], KEY_TERMS, CONTEXT)
            no = has_context(text, s["start"], s["end"], NOT_KEY_TERMS, CONTEXT)
            grade = F.when(yes & valid, F.lit(3)).when(yes, F.lit(2)).when(no | ~valid | F.lit(context_required), F.lit(0)).otherwise(F.lit(1))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), grade.alias("grade"))

        graded = F.filter(F.transform(spans, judged), lambda s: s["grade"] > 0)
        level = lambda s: F.when(s["grade"] == 3, "CRITICAL").when(s["grade"] == 2, "HIGH").otherwise("MEDIUM")
        sure = lambda s: F.when(s["grade"] == 3, 0.95).when(s["grade"] == 2, 0.6).otherwise(0.5)
        certain = F.transform(aip, lambda s: finding(s, "PRIVATE_KEY_HEX", "CRITICAL", 0.98, rule, "AIP-80 private key"))
        return F.concat(certain, F.transform(graded, lambda s: finding(s, "PRIVATE_KEY_HEX", level(s), sure(s), rule, "64 hex digits as a private key")))

    gate = long_run(text) if gate is None else gate
    return F.when(gate & F.rlike(text, F.lit("(?i)[0-9a-f]{64}")), let(regex_spans(text, AIP80), plain)).otherwise(no_findings())


def solana_keypair(text: Column) -> Column:
    """An array of exactly 64 numbers, each a byte."""
    numbers = lambda s: F.split(F.regexp_replace(s["value"], "[\\[\\]\\s]", ""), ",", -1)
    test = lambda s: let(numbers(s), lambda ns: (F.size(ns) == 64) & F.forall(ns, lambda n: n.cast("int").between(0, 255)))

    def make(s: Column) -> Column:
        near = has_context(text, s["start"], s["end"], SOLANA_TERMS, SOLANA_CONTEXT)
        return finding(s, "SOLANA_KEYPAIR", F.when(near, "CRITICAL").otherwise("MEDIUM"), F.when(near, 0.95).otherwise(0.4), "solana-keypair", "64 byte values")

    return _kept(regex_spans(text, SOLANA, F.contains(text, F.lit("["))), test, make)


def _whole_json(text: Column, start: Column) -> Column:
    """Span from the first { to the last }, or from start to the end."""
    first, last = F.locate("{", text), F.length(text) - F.locate("}", F.reverse(text)) + 1
    found = (first > 0) & (F.locate("}", text) > 0) & (last >= first)
    return F.struct(F.when(found, first - 1).otherwise(start).cast("int").alias("start"), F.when(found, last).otherwise(F.length(text)).cast("int").alias("end"))


def _start_of(text: Column, pattern: str) -> Column:
    return F.length(F.get(F.split(text, pattern, 2), F.lit(0)))


def cardano_signing_key(text: Column, gate: Column | None = None) -> Column:
    kind = "(?i)\"type\"\\s*:\\s*\"\\w*SigningKey\\w*\""
    found = F.array(finding(_whole_json(text, _start_of(text, kind)), "CARDANO_SIGNING_KEY", "CRITICAL", 0.97, "cardano-signing-key", "signing key envelope"))
    gate = F.lit(True) if gate is None else gate
    return F.when(gate & F.rlike(text, F.lit(kind)) & F.rlike(text, F.lit("(?i)\"cborHex\"\\s*:")), found).otherwise(no_findings())


def keystore_json(text: Column) -> Column:
    keys = ["crypto", "cipher", "ciphertext", "kdf", "mac", "address"]
    every = F.contains(text, F.lit("\""))
    for k in keys:
        every = every & F.rlike(text, F.lit(f"(?i)\"{k}\"\\s*:"))
    found = F.array(finding(_whole_json(text, _start_of(text, "(?i)\"crypto\"\\s*:")), "KEYSTORE_JSON", "CRITICAL", 0.97, "keystore-json", "encrypted keystore"))
    return F.when(every, found).otherwise(no_findings())


def pem_private_key(text: Column) -> Column:
    return F.transform(regex_spans(text, PEM, F.contains(text, F.lit("PRIVATE KEY"))), lambda s: finding(s, "PEM_PRIVATE_KEY", "CRITICAL", 0.99, "pem-private-key", "PEM block"))


def codec_candidates(text: Column, gate: Column | None = None) -> Column:
    """array<struct<rule, start, end, value>> for `codecs.verified`, in order of the rules."""
    tag = lambda rule, spans: F.transform(spans, lambda s: F.struct(F.lit(rule).alias("rule"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    found = F.concat(tag("bitcoin-wif", regex_spans(text, WIF)), tag("extended-key", regex_spans(text, EXTENDED)), tag("sui-privkey", regex_spans(text, SUI)), tag("stellar-seed", regex_spans(text, STELLAR)))
    return found if gate is None else F.when(gate, found).otherwise(F.array().cast(CANDIDATES))


def codec_matches(candidates: Column, verdicts: Column, rule: str) -> Column:
    """Findings of one codec rule from the candidates and what `codecs.verified` says of each."""
    both = F.filter(F.arrays_zip(candidates.alias("c"), verdicts.alias("v")), lambda x: (x["c"]["rule"] == rule) & x["v"].isNotNull())
    if rule == "extended-key":
        public = lambda x: x["v"] == "public"
        return F.transform(both, lambda x: finding(x["c"], F.when(public(x), "EXTENDED_PUBLIC_KEY").otherwise("EXTENDED_PRIVATE_KEY"), F.when(public(x), "HIGH").otherwise("CRITICAL"), F.when(public(x), 0.85).otherwise(0.98), rule, "extended key"))
    entity = {"bitcoin-wif": "PRIVATE_KEY_WIF", "sui-privkey": "SUI_PRIVKEY", "stellar-seed": "STELLAR_SECRET_SEED"}[rule]
    return F.transform(both, lambda x: finding(x["c"], entity, "CRITICAL", 0.98, rule, "checksum holds"))


def substrate_uri(text: Column, gate: Column | None = None) -> Column:
    """A hex seed with derivation junctions after it: our reading of the public URI grammar."""
    pattern = "(?<![0-9A-Za-z])0x[0-9a-fA-F]{64}(?:(?<!/)//?(?!/)[^/\\s]+)+(?:///\\S+)?"
    return F.transform(regex_spans(text, pattern, gate), lambda s: finding(s, "BLOCKCHAIN_SUBSTRATE_SECRET_URI", "CRITICAL", 0.95, "substrate-secret-uri", "seed with junctions"))


def address_kind(token: Column) -> Column:
    """ADDRESS, TX_HASH or null."""
    address = F.rlike(token, F.lit("(?i)^0x[0-9a-f]{40}$")) | F.rlike(token, F.lit("^[13][1-9A-HJ-NP-Za-km-z]{25,34}$"))
    return F.when(address, "ADDRESS").when(F.rlike(token, F.lit("(?i)^0x[0-9a-f]{64}$")), "TX_HASH")


def addresses(text: Column, gate: Column | None = None) -> Column:
    gate = alnum_run(text, ADDRESS_RUN) if gate is None else gate
    spans = F.concat(regex_spans(text, EVM_ADDRESS, gate & F.contains(text, F.lit("0x"))), regex_spans(text, BTC_ADDRESS, gate))
    kept = F.filter(spans, lambda s: address_kind(s["value"]).isNotNull())
    known = lambda s: address_kind(s["value"]) == "ADDRESS"
    address = F.transform(kept, lambda s: F.when(known(s), finding(s, "ADDRESS", "LOW", 0.95, "blockchain-address", "public identifier")).otherwise(finding(s, "TX_HASH", "LOW", 0.95, "blockchain-tx-hash", "public identifier")))
    return address


def email(text: Column) -> Column:
    return F.transform(regex_spans(text, EMAIL, F.contains(text, F.lit("@"))), lambda s: finding(s, "PII", "MEDIUM", 0.95, "pii-email", "e-mail address"))


def cn_phone(text: Column, gate: Column | None = None) -> Column:
    return F.transform(regex_spans(text, CN_PHONE, gate), lambda s: finding(s, "PII", "MEDIUM", 0.85, "pii-cn-phone", "phone number"))


def cn_id_card(text: Column, gate: Column | None = None) -> Column:
    return _kept(regex_spans(text, CN_ID, gate), lambda s: crypto.id_card_valid(s["value"]), lambda s: finding(s, "PII", "MEDIUM", 0.9, "pii-cn-id-card", "identity number"))


def bank_card(text: Column, others: Column, gate: Column | None = None) -> Column:
    """Digit runs with a valid check digit that overlap none of the other findings."""
    return _kept(regex_spans(text, BANK_CARD, gate), lambda s: F.call_function("luhn_check", s["value"]) & ~_overlaps(s, others), lambda s: finding(s, "PII", "MEDIUM", 0.7, "pii-bank-card", "bank card number"))


def pii(text: Column, gate: Column | None = None) -> Column:
    """All personal data; gate: whether the text has a digit run, found once for the three kinds of numbers."""

    def of(digits: Column) -> Column:
        return let(F.concat(cn_id_card(text, digits), email(text), cn_phone(text, digits)), lambda first: F.concat(first, bank_card(text, first, digits)))

    return let(F.rlike(text, F.lit(f"[0-9]{{{DIGIT_RUN}}}")), of) if gate is None else of(gate)


def _captured(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """Spans of the last group of a pattern, which ends where the match ends."""
    value = lambda s: F.regexp_extract(s["value"], pattern, 1)
    return F.transform(regex_spans(text, pattern, gate), lambda s: F.struct((s["end"] - F.length(value(s))).alias("start"), s["end"].alias("end"), value(s).alias("value")))


def credentials(text: Column, named: Column | None = None, password: Column | None = None, entropy: float = MIN_ENTROPY) -> Column:
    def format_of(rule: str, entity: str, sure: float, needs: str, pattern: str) -> Column:
        return F.transform(regex_spans(text, pattern, F.contains(text, F.lit(needs))), lambda s: finding(s, entity, "HIGH", sure, rule, "credential format"))

    parts = [format_of(*c) for c in CREDENTIALS]
    parts.append(_kept(_captured(text, GENERIC_SECRET, named), lambda s: crypto.shannon(s["value"]) >= entropy, lambda s: finding(s, "API_KEY", "HIGH", 0.6, "credential-generic", "named secret of high entropy")))
    parts.append(F.transform(_captured(text, PASSWORD, password), lambda s: finding(s, "PASSWORD", "HIGH", 0.9, "credential-password", "named password")))
    return F.concat(*parts)


def prompt_injection(text: Column) -> Column:
    """The local scanner finds nothing; injections come from a provider."""
    return no_findings()


CODEC_RULES = list(codecs.CHECKS)

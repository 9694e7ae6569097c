"""The registered queries of the engine, and for each the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, crypto, spans
from ..operators import conversations, mnemonics, structured
from ..operators import rules as R
from ..sources import providers, settings
from ..sources.audit import AuditLog
from ..sources.planted import planted, planted_sql
from ..sources.tables import dealt, shared_folder, spread, table
from ..sources.wordlists import han_wordlist, syllable_wordlist
from ..streaming import conversations as stream
from . import acceptance, configured, inspection, policy

PEPPER = "query-pepper"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def texts(spark: SparkSession, sf_dir: str, name: str, *more: str) -> DataFrame:
    """(doc_id, text, more...) of a given table or a planted relation, spread over all cores."""
    if name == "pages":
        return spread(table(spark, sf_dir, name).select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))
    if name.startswith("planted"):
        return planted(spark, sf_dir, name)
    return spread(table(spark, sf_dir, name).select("doc_id", "text", *more))


def source_sql(name: str) -> str:
    if name == "pages":
        return "SELECT page_id AS doc_id, html AS text FROM pages"
    return planted_sql(name) if name.startswith("planted") else f"SELECT doc_id, text FROM {name}"


def findings_of(df: DataFrame, rule: Callable[[Column], Column]) -> DataFrame:
    """A row for each finding of a rule, with the other columns of its text."""
    more = [c for c in df.columns if c not in ("doc_id", "text")]
    rows = df.select("doc_id", *more, F.explode(rule(F.coalesce(F.col("text"), F.lit(""))).cast(spans.FINDINGS)).alias("f"))
    return rows.select("doc_id", *more, "f.rule_id", "f.entity_type", "f.risk_level", "f.confidence", F.col("f.start").alias("start_at"), F.col("f.end").alias("end_at"))


# SQL pieces --------------------------------------------------------------------------------------------------------


def spans_sql(source: str, pattern: str, group: int = 0) -> str:
    """(doc_id, text, v, s, e) of the matches of a pattern without lookaround; with a group, of the group that ends a match."""
    p = pattern.replace("'", "''")
    value = f"regexp_extract(v0, '{p}', {group})" if group else "v0"
    return f"""(SELECT doc_id, text, {value} AS v, e0 - length({value}) AS s, e0 AS e FROM (
        SELECT doc_id, text, m[i] AS v0, list_sum([length(x) FOR x IN g[1:i]]) + list_sum([length(x) FOR x IN m[1:i]]) AS e0 FROM (
        SELECT doc_id, text, m, g, unnest(generate_series(1, len(m))) AS i FROM (
        SELECT doc_id, text, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM ({source}) WHERE regexp_matches(text, '{p}')))))"""


def finding_sql(source: str, rule: str, entity: str, risk: str, confidence: str, where: str = "true") -> str:
    return f"SELECT doc_id, '{rule}' AS rule_id, '{entity}' AS entity_type, '{risk}' AS risk_level, CAST({confidence} AS DOUBLE) AS confidence, CAST(s AS INT) AS start_at, CAST(e AS INT) AS end_at FROM {source} WHERE {where}"


DIGITS, ID_RUN, ALNUM, B58_RUN = "[0-9]+", "[0-9Xx]+", "[0-9A-Za-z]+", "[1-9A-HJ-NP-Za-km-z]+"
LUHN_SQL = "list_sum([CASE WHEN (length(v) - i) % 2 = 0 THEN CAST(v[i] AS INT) ELSE (CAST(v[i] AS INT) * 2) // 10 + (CAST(v[i] AS INT) * 2) % 10 END FOR i IN generate_series(1, length(v))]) % 10 = 0"
ID_SQL = "regexp_full_match(v, '[1-9][0-9]{5}(19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]') AND substr('10X98765432', 1 + CAST(list_sum([CAST(v[i] AS INT) * [7,9,10,5,8,4,2,1,6,3,7,9,10,5,8,4,2][i] FOR i IN generate_series(1, 17)]) % 11 AS INT), 1) = upper(v[18])"


def email_sql(src: str) -> str:
    return finding_sql(spans_sql(src, R.EMAIL), "pii-email", "PII", "MEDIUM", "0.95")


def phone_sql(src: str) -> str:
    return finding_sql(spans_sql(src, DIGITS), "pii-cn-phone", "PII", "MEDIUM", "0.85", "regexp_full_match(v, '1[3-9][0-9]{9}')")


def id_sql(src: str) -> str:
    return finding_sql(spans_sql(src, ID_RUN), "pii-cn-id-card", "PII", "MEDIUM", "0.9", f"CASE WHEN length(v) = 18 AND regexp_full_match(v, '[0-9]{{17}}[0-9Xx]') THEN {ID_SQL} ELSE false END")


def pii_sql(src: str) -> str:
    first = f"SELECT * FROM ({id_sql(src)}) UNION ALL SELECT * FROM ({email_sql(src)}) UNION ALL SELECT * FROM ({phone_sql(src)})"
    card = finding_sql(spans_sql(src, DIGITS), "pii-bank-card", "PII", "MEDIUM", "0.7", f"CASE WHEN length(v) BETWEEN 13 AND 19 THEN {LUHN_SQL} ELSE false END")
    return f"WITH f AS MATERIALIZED ({first}), c AS MATERIALIZED ({card}) SELECT * FROM f UNION ALL SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = c.doc_id AND f.start_at < c.end_at AND c.start_at < f.end_at)"


def context_sql(terms: list[str], width: int = R.CONTEXT) -> str:
    near = f"lower(substr(text, CAST(greatest(s - {width}, 0) + 1 AS BIGINT), CAST(e + {width} - greatest(s - {width}, 0) AS BIGINT)))"
    return "(" + " OR ".join(f"contains({near}, '{t}')" for t in terms) + ")"


VALID_SQL = f"lower(right(v, 64)) BETWEEN '{crypto.SECP256K1_FIRST}' AND '{crypto.SECP256K1_LAST}'"


def hex_sql(src: str) -> str:
    yes, no = context_sql(R.KEY_TERMS), context_sql(R.NOT_KEY_TERMS)
    aip = spans_sql(src, R.AIP80)
    grade = f"CASE WHEN {yes} AND {VALID_SQL} THEN 3 WHEN {yes} THEN 2 WHEN {no} OR NOT ({VALID_SQL}) THEN 0 ELSE 1 END"
    return f"""WITH a AS MATERIALIZED (SELECT * FROM {aip}), h AS MATERIALIZED (SELECT *, {grade} AS grade FROM {spans_sql(src, R.HEX64)})
        SELECT doc_id, 'evm-privkey-hex' AS rule_id, 'PRIVATE_KEY_HEX' AS entity_type, 'CRITICAL' AS risk_level, CAST(0.98 AS DOUBLE) AS confidence, CAST(s AS INT) AS start_at, CAST(e AS INT) AS end_at FROM a
        UNION ALL SELECT doc_id, 'evm-privkey-hex', 'PRIVATE_KEY_HEX', CASE grade WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' ELSE 'MEDIUM' END, CAST(CASE grade WHEN 3 THEN 0.95 WHEN 2 THEN 0.6 ELSE 0.5 END AS DOUBLE), CAST(s AS INT), CAST(e AS INT) FROM h
        WHERE grade > 0 AND NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = h.doc_id AND h.s >= a.s AND h.s < a.e)"""


def address_sql(src: str) -> str:
    evm = f"(SELECT doc_id, text, regexp_extract(v, '^0x[0-9a-fA-F]+') AS v, s, s + length(regexp_extract(v, '^0x[0-9a-fA-F]+')) AS e FROM {spans_sql(src, ALNUM)} WHERE regexp_matches(v, '^0x[0-9a-fA-F]'))"
    btc = finding_sql(spans_sql(src, B58_RUN), "blockchain-address", "ADDRESS", "LOW", "0.95", "regexp_full_match(v, '[13][1-9A-HJ-NP-Za-km-z]{25,34}')")
    return f"""{finding_sql(evm, "blockchain-address", "ADDRESS", "LOW", "0.95", "length(v) = 42")} UNION ALL {finding_sql(evm, "blockchain-tx-hash", "TX_HASH", "LOW", "0.95", "length(v) = 66")} UNION ALL {btc}"""


def bounded_sql(src: str, full: str, run: str = ALNUM) -> str:
    return f"(SELECT * FROM {spans_sql(src, run)} WHERE regexp_full_match(v, '{full}'))"


def credentials_sql(src: str) -> str:
    return " UNION ALL ".join(
        [
            finding_sql(spans_sql(src, "(^|[^0-9A-Za-z])(sk-[A-Za-z0-9_\\-]*T3BlbkFJ[A-Za-z0-9_\\-]*)", 2), "credential-openai", "API_KEY", "HIGH", "0.9"),
            finding_sql(bounded_sql(src, "AIza[0-9A-Za-z_\\-]{35}", "[0-9A-Za-z_\\-]+"), "credential-gcp", "API_KEY", "HIGH", "0.9"),
            finding_sql(spans_sql(src, "(^|[^0-9A-Za-z])(ey[A-Za-z0-9_-]+\\.ey[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+)", 2), "credential-jwt", "JWT", "HIGH", "0.85"),
            finding_sql(bounded_sql(src, "AKIA[0-9A-Z]{16}"), "credential-aws", "API_KEY", "HIGH", "0.95"),
            finding_sql(bounded_sql(src, "ghp_[0-9A-Za-z]{36}", "[0-9A-Za-z_]+"), "credential-github-pat", "API_KEY", "HIGH", "0.95"),
            finding_sql(spans_sql(src, R.GENERIC_SECRET, 1), "credential-generic", "API_KEY", "HIGH", "0.6", f"list_aggregate(string_split(v, ''), 'entropy') >= {R.MIN_ENTROPY}"),
            finding_sql(spans_sql(src, R.PASSWORD, 1), "credential-password", "PASSWORD", "HIGH", "0.9"),
        ]
    )


def pem_sql(src: str) -> str:
    return finding_sql(spans_sql(src, R.PEM), "pem-private-key", "PEM_PRIVATE_KEY", "CRITICAL", "0.99")


def _json_sql(src: str, *patterns: str) -> str:
    where = " AND ".join(f"regexp_matches(text, '{p}')" for p in patterns)
    return f"(SELECT doc_id, text, strpos(text, '{{') - 1 AS s, length(text) - strpos(reverse(text), '}}') + 1 AS e FROM ({src}) WHERE {where})"


def keystore_sql(src: str) -> str:
    return finding_sql(_json_sql(src, *(f'(?i)"{k}"\\s*:' for k in ("crypto", "cipher", "ciphertext", "kdf", "mac", "address"))), "keystore-json", "KEYSTORE_JSON", "CRITICAL", "0.97")


def cardano_sql(src: str) -> str:
    return finding_sql(_json_sql(src, '(?i)"type"\\s*:\\s*"\\w*SigningKey\\w*"', '(?i)"cborHex"\\s*:'), "cardano-signing-key", "CARDANO_SIGNING_KEY", "CRITICAL", "0.97")


def solana_sql(src: str) -> str:
    found = f"(SELECT *, {context_sql(R.SOLANA_TERMS, R.SOLANA_CONTEXT)} AS near FROM {spans_sql(src, R.SOLANA)} WHERE len(string_split(v, ',')) = 64 AND list_bool_and([CAST(x AS INT) BETWEEN 0 AND 255 FOR x IN string_split(regexp_replace(v, '[\\[\\]\\s]', '', 'g'), ',')]))"
    return f"SELECT doc_id, 'solana-keypair' AS rule_id, 'SOLANA_KEYPAIR' AS entity_type, CASE WHEN near THEN 'CRITICAL' ELSE 'MEDIUM' END AS risk_level, CAST(CASE WHEN near THEN 0.95 ELSE 0.4 END AS DOUBLE) AS confidence, CAST(s AS INT) AS start_at, CAST(e AS INT) AS end_at FROM {found}"


def substrate_sql(src: str) -> str:
    return finding_sql(spans_sql(src, "(^|[^0-9A-Za-z])(0x[0-9a-fA-F]{64}(//?[^/\\s]+)+(///[^\\s]+)?)", 2), "substrate-secret-uri", "BLOCKCHAIN_SUBSTRATE_SECRET_URI", "CRITICAL", "0.95")


_BITS = "list_aggregate([lpad(CAST(bin(k) AS VARCHAR), 11, '0') FOR k IN w], 'string_agg', '')"
_ENTROPY = "unhex(list_aggregate([substr('0123456789abcdef', 8 * CAST(bits[4 * j + 1] AS INT) + 4 * CAST(bits[4 * j + 2] AS INT) + 2 * CAST(bits[4 * j + 3] AS INT) + CAST(bits[4 * j + 4] AS INT) + 1, 1) FOR j IN generate_series(0, (c * 11 - check_bits) // 4 - 1)], 'string_agg', ''))"

#: White space and the blocks of signs that part words.
_BREAKS = "[\\t-\\r\\x{1C}-\\x{20}\\x{1680}\\x{2000}-\\x{2006}\\x{2008}-\\x{200A}\\x{2028}\\x{2029}\\x{205F}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}\\p{Han}]+"
_SYLLABLES = "strpos('bcdfghjklmnpqrst', lower(v)[1]) * 128 + strpos('aeio', lower(v)[2]) * 32 + strpos('bdfgklmn', lower(v)[3]) * 4 + strpos('aeio', lower(v)[4]) - 165"


def mnemonic_sql(src: str) -> str:
    """Windows of list words, numbered in runs; the bits of a window and its checksum."""
    digest = "substr(lpad(bin(CAST(('0x' || substr(digest, 1, 2)) AS INT)), 8, '0'), 1, check_bits)"
    return f"""WITH g AS (SELECT doc_id, text, string_split_regex(text, '{_BREAKS}') AS ws, regexp_extract_all(text, '{_BREAKS}') AS bs FROM ({src}) WHERE text IS NOT NULL),
        p AS (SELECT doc_id, i, ws[i] AS v, length(ws[i]) + coalesce(length(bs[i]), 0) AS size FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM g)),
        o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p),
        h AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run, {_SYLLABLES} AS k FROM o WHERE regexp_full_match(lower(v), '[bcdfghjklmnpqrst][aeio][bdfgklmn][aeio]')),
        r AS (SELECT doc_id, list(k ORDER BY i) AS ks, list(s ORDER BY i) AS ss FROM h GROUP BY doc_id, run HAVING count(*) >= 12),
        w AS (SELECT doc_id, c, q, ks[q + 1 : q + c] AS w, ss[q + 1] AS s, ss[q + c] + 4 AS e, c * 11 // 33 AS check_bits FROM (SELECT *, unnest(generate_series(0, len(ks) - c)) AS q FROM (SELECT *, unnest([12, 15, 18, 21, 24]) AS c FROM r) WHERE len(ks) >= c)),
        b AS (SELECT *, {_BITS} AS bits FROM w), d AS (SELECT *, sha256({_ENTROPY}) AS digest FROM b),
        x AS (SELECT d.doc_id, text, s, e, {digest} = right(bits, check_bits) AS good FROM d JOIN ({src}) t ON t.doc_id = d.doc_id)
        SELECT doc_id, 'bip39-mnemonic' AS rule_id, 'MNEMONIC' AS entity_type, CASE WHEN good THEN 'CRITICAL' ELSE 'HIGH' END AS risk_level, CAST(CASE WHEN good THEN 0.99 ELSE 0.6 END AS DOUBLE) AS confidence, CAST(s AS INT) AS start_at, CAST(e AS INT) AS end_at FROM x WHERE good OR {context_sql(R.MNEMONIC_TERMS)}"""


def hmac_sql(value: str, key: str = PEPPER) -> str:
    inner, outer = crypto.hmac_pads(key)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}))))"


# rules over texts --------------------------------------------------------------------------------------------------

query("pii_email_spans", email_sql(source_sql("documents")))(lambda s, d: findings_of(texts(s, d, "documents"), R.email))
query("pii_cn_phone", phone_sql(source_sql("planted_pii")))(lambda s, d: findings_of(texts(s, d, "planted_pii"), R.cn_phone))
query("pii_cn_id_card", id_sql(source_sql("planted_pii")))(lambda s, d: findings_of(texts(s, d, "planted_pii"), R.cn_id_card))
query("pii_bank_card", f"SELECT * FROM ({pii_sql(source_sql('documents'))}) WHERE rule_id = 'pii-bank-card'")(lambda s, d: findings_of(texts(s, d, "documents"), R.pii).where("rule_id = 'pii-bank-card'"))
query("pii_planted", pii_sql(source_sql("planted_pii")))(lambda s, d: findings_of(texts(s, d, "planted_pii"), R.pii))
query("pii_pages", pii_sql(source_sql("pages")))(lambda s, d: findings_of(texts(s, d, "pages"), R.pii))
query("evm_key_hex", hex_sql(source_sql("planted_hex")))(lambda s, d: findings_of(texts(s, d, "planted_hex"), R.evm_private_key))
query("aip80_keys", f"SELECT * FROM ({hex_sql(source_sql('planted_hex'))}) WHERE confidence = 0.98")(lambda s, d: findings_of(texts(s, d, "planted_hex"), R.evm_private_key).where("confidence = 0.98D"))
query("address_txhash", address_sql(source_sql("planted_address")))(lambda s, d: findings_of(texts(s, d, "planted_address"), R.addresses))
query("credentials_prefix", f"SELECT * FROM ({credentials_sql(source_sql('planted_cred'))}) WHERE rule_id IN ('credential-aws', 'credential-github-pat')")(lambda s, d: findings_of(texts(s, d, "planted_cred"), R.credentials).where("rule_id in ('credential-aws', 'credential-github-pat')"))
query("credentials_generic", f"SELECT * FROM ({credentials_sql(source_sql('documents'))}) WHERE rule_id = 'credential-generic'")(lambda s, d: findings_of(texts(s, d, "documents"), R.credentials).where("rule_id = 'credential-generic'"))
query("credentials_planted", credentials_sql(source_sql("planted_cred")))(lambda s, d: findings_of(texts(s, d, "planted_cred"), R.credentials))
query("password_field", f"SELECT * FROM ({credentials_sql(source_sql('planted_cred'))}) WHERE rule_id = 'credential-password'")(lambda s, d: findings_of(texts(s, d, "planted_cred"), R.credentials).where("rule_id = 'credential-password'"))
query("pem_blocks", pem_sql(source_sql("planted_files")))(lambda s, d: findings_of(texts(s, d, "planted_files"), R.pem_private_key))

query("keystore_json", keystore_sql(source_sql("planted_files")))(lambda s, d: findings_of(texts(s, d, "planted_files"), R.keystore_json))
query("cardano_skey", cardano_sql(source_sql("planted_files")))(lambda s, d: findings_of(texts(s, d, "planted_files"), R.cardano_signing_key))
query("solana_keypair", solana_sql(source_sql("planted_files")))(lambda s, d: findings_of(texts(s, d, "planted_files"), R.solana_keypair))

# codecs: keys with all-zero payloads, told apart by the key of the row
_ZERO_KEYS = [
    codecs.base58check_encode(b"\x80" + bytes(32) + b"\x01"), codecs.base58check_encode(b"\x00" + bytes(32)), codecs.base58check_encode(bytes.fromhex("0488ADE4") + bytes(74)), codecs.base58check_encode(bytes.fromhex("0488B21E") + bytes(74)),
    codecs.bech32_encode("suiprivkey", codecs.convert_bits(bytes(33), 8, 5, True)), "suiprivkey1" + "q" * 58,
]
_ZERO_KINDS = ["PRIVATE_KEY_WIF", None, "EXTENDED_PRIVATE_KEY", "EXTENDED_PUBLIC_KEY", "SUI_PRIVKEY", None]
_PICK = "CASE s_suppkey % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_ZERO_KEYS)) + " END"
_KIND = "CASE s_suppkey % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_ZERO_KINDS) if k) + " END"


@query("codec_keys", f"SELECT s_suppkey AS doc_id, {_KIND} AS entity_type, CAST(length(s_name) + 6 AS INT) AS start_at, CAST(length(s_name) + 6 + length({_PICK}) AS INT) AS end_at FROM supplier WHERE {_KIND} IS NOT NULL")
def codec_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dealt(table(spark, sf_dir, "supplier")).select(F.col("s_suppkey").alias("doc_id"), F.expr(f"concat(s_name, ' key: ', {_PICK})").alias("text"))
    found = spans.each(inspection.detect(df), "secrets", "doc_id")
    return found.select("doc_id", "f.entity_type", F.col("f.start").alias("start_at"), F.col("f.end").alias("end_at"))


# functions ---------------------------------------------------------------------------------------------------------

query("secp_range", f"SELECT o_orderkey, v < 'f' AS low, {VALID_SQL} AS valid FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN repeat('f', 64) WHEN o_orderkey % 7 = 1 THEN repeat('0', 64) ELSE sha256(CAST(o_orderkey AS VARCHAR)) END AS v FROM orders)")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.expr("case when o_orderkey % 7 = 0 then repeat('f', 64) when o_orderkey % 7 = 1 then repeat('0', 64) else sha2(cast(o_orderkey as string), 256) end").alias("v")).select("o_orderkey", (F.col("v") < "f").alias("low"), crypto.secp256k1_valid(F.col("v")).alias("valid"))
)
query("shannon_entropy", "SELECT c_custkey, round(list_aggregate(string_split(c_name || c_mktsegment, ''), 'entropy'), 6) AS bits FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", F.round(crypto.shannon(F.concat("c_name", "c_mktsegment")), 6).alias("bits")))
query("fingerprints", f"SELECT c_custkey, {hmac_sql('c_name')} AS full_hex, substr({hmac_sql('c_name')}, 1, 8) AS short_hex FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", crypto.hmac_sha256(F.col("c_name"), PEPPER).alias("full_hex"), crypto.fingerprint(F.col("c_name"), PEPPER).alias("short_hex")))
query("double_sha256", "SELECT c_custkey, sha256(unhex(sha256(unhex(sha256(c_name))))) AS digest FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", crypto.double_sha256(F.sha2("c_name", 256)).alias("digest")))
query("context_window", f"SELECT doc_id, CAST(s AS INT) AS start_at, {context_sql(R.KEY_TERMS)} AS positive, {context_sql(R.NOT_KEY_TERMS)} AS negative FROM {spans_sql(source_sql('planted_hex'), R.HEX64)}")(
    lambda s, d: texts(s, d, "planted_hex").select("doc_id", "text", F.explode(spans.regex_spans(F.col("text"), R.HEX64)).alias("x")).select("doc_id", F.col("x.start").alias("start_at"), spans.has_context(F.col("text"), F.col("x.start"), F.col("x.end"), R.KEY_TERMS, R.CONTEXT).alias("positive"), spans.has_context(F.col("text"), F.col("x.start"), F.col("x.end"), R.NOT_KEY_TERMS, R.CONTEXT).alias("negative"))
)
query("lang_route", "SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') THEN 'zh' ELSE 'en' END AS lang FROM documents")(lambda s, d: texts(s, d, "documents").select("doc_id", providers.language(F.col("text")).alias("lang")))
query("turn_normalize", "SELECT conv_id, turn, trim(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')) AS norm, regexp_replace(text, '\\s+', '', 'g') AS stripped FROM conversations")(lambda s, d: table(s, d, "conversations").select("conv_id", "turn", conversations.normalised(F.col("text")).alias("norm"), F.regexp_replace("text", "\\s+", "").alias("stripped")))

# merging, masking, policy ------------------------------------------------------------------------------------------

#: Findings with overlapping spans, from the lines of orders.
_LINES = "SELECT l_orderkey AS doc_id, l_linenumber AS seq, CASE l_linenumber % 2 WHEN 0 THEN 'PII' ELSE 'API_KEY' END AS entity_type, CASE l_returnflag WHEN 'A' THEN 'LOW' WHEN 'N' THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level, CAST(l_partkey % 40 AS INT) AS start_at, CAST(l_partkey % 40 + 3 + l_suppkey % 9 AS INT) AS end_at FROM {lineitem}"
_RISK_SQL = "CASE risk_level WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END"


def merge_sql(by: str) -> str:
    """Gaps and islands: a span starts an island unless an earlier one reaches beyond its start."""
    order = "ORDER BY start_at, end_at DESC, seq"
    return f"""WITH f AS ({_LINES.format(lineitem="lineitem")}),
        n AS (SELECT *, CASE WHEN start_at < max(end_at) OVER (PARTITION BY {by} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM f),
        i AS (SELECT *, sum(new) OVER (PARTITION BY {by} {order} ROWS UNBOUNDED PRECEDING) AS island, row_number() OVER (PARTITION BY {by} {order}) AS rn FROM n)
        SELECT doc_id, arg_max(entity_type, {_RISK_SQL} * 1000 - rn) AS entity_type, arg_max(risk_level, {_RISK_SQL} * 1000 - rn) AS risk_level, min(start_at) AS start_at, max(end_at) AS end_at FROM i GROUP BY {by}, island"""


def _line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_LINES.format(lineitem=f"parquet.`{sf_dir}/lineitem.parquet`"))
    one = F.struct("entity_type", "risk_level", F.lit(0.5).alias("confidence"), F.col("start_at").alias("start"), F.col("end_at").alias("end"), F.lit("line").alias("rule_id"), F.lit("").alias("reason"))
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", one.alias("f")))), lambda x: x["f"]).cast(spans.FINDINGS).alias("found"))


def _exploded(df: DataFrame, merged: Column) -> DataFrame:
    return spans.each(df.select("doc_id", merged.alias("merged")), "merged", "doc_id").select("doc_id", "f.entity_type", "f.risk_level", F.col("f.start").alias("start_at"), F.col("f.end").alias("end_at"))


query("span_merge_all", merge_sql("doc_id"))(lambda s, d: _exploded(_line_findings(s, d), spans.merge(F.col("found"))))
query("span_merge_type", merge_sql("doc_id, entity_type"))(lambda s, d: _exploded(_line_findings(s, d), spans.merge_within_type(F.col("found"))))

_POLICY_VALUES = ", ".join(f"('{e}', '{x}', '{policy.default_action(e, x)}')" for e in policy.ENTITIES for x in policy.DIRECTIONS)
_DIRECTIONS = "[" + ", ".join(f"'{x}'" for x in policy.DIRECTIONS) + "]"
_TYPES = "[" + ", ".join(f"'{x}'" for x in [*policy.ENTITIES, "UNKNOWN"]) + "]"
_DECIDE = f"""SELECT l_orderkey AS doc_id, l_linenumber AS seq, entity_type, direction, risk_level, CASE WHEN risk_level = 'CRITICAL' AND entity_type IN ({", ".join(f"'{k}'" for k in policy.KEYS)}) THEN 'BLOCK' ELSE coalesce(action, 'MASK') END AS action
    FROM (SELECT l_orderkey, l_linenumber, {_TYPES}[1 + CAST(l_partkey % {len(policy.ENTITIES) + 1} AS INT)] AS entity_type, {_DIRECTIONS}[1 + CAST(l_suppkey % {len(policy.DIRECTIONS)} AS INT)] AS direction, CASE l_returnflag WHEN 'A' THEN 'LOW' WHEN 'N' THEN 'MEDIUM' ELSE 'CRITICAL' END AS risk_level FROM lineitem)
    LEFT JOIN (VALUES {_POLICY_VALUES}) AS p(pe, pd, action) ON pe = entity_type AND pd = direction"""


@query("policy_decide", _DECIDE)
def policy_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, key: F.get(F.array(*map(F.lit, names)), (F.col(key) % len(names)).cast("int"))
    risk = F.when(F.col("l_returnflag") == "A", "LOW").when(F.col("l_returnflag") == "N", "MEDIUM").otherwise("CRITICAL")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), pick([*policy.ENTITIES, "UNKNOWN"], "l_partkey").alias("entity_type"), pick(policy.DIRECTIONS, "l_suppkey").alias("direction"), risk.alias("risk_level"))
    return policy.decide(rows, policy.default_policy(spark)).select("doc_id", "seq", "entity_type", "direction", "risk_level", "action")


_SEVERITY = "CASE action WHEN 'ALLOW' THEN 1 WHEN 'REVIEW' THEN 2 WHEN 'MASK' THEN 3 ELSE 4 END"
query("strictest_action", f"SELECT doc_id, arg_max(action, {_SEVERITY}) AS action, count(*) AS n FROM ({_DECIDE}) GROUP BY doc_id")(lambda s, d: policy_decide(s, d).groupBy("doc_id").agg(F.max_by("action", policy.severity(F.col("action"))).alias("action"), F.count(F.lit(1)).alias("n")))

_EMAIL_QUOTED = R.EMAIL.replace("'", "''")
query("mask_emails", f"SELECT doc_id, regexp_replace(text, '{_EMAIL_QUOTED}', '[PII:EMAIL]', 'g') AS masked FROM documents")(lambda s, d: texts(s, d, "documents").select("doc_id", inspection.mask(F.col("text"), R.email(F.col("text")), PEPPER).alias("masked")))
query("mask_addresses", f"SELECT doc_id, CASE WHEN v IS NULL THEN text ELSE substr(text, 1, s) || substr(v, 1, 6) || '...' || right(v, 4) || substr(text, e + 1) END AS masked FROM ({source_sql('planted_address')}) LEFT JOIN (SELECT doc_id, start_at AS s, end_at AS e, substr(t.text, start_at + 1, end_at - start_at) AS v FROM (SELECT doc_id, min(start_at) AS start_at, arg_min(end_at, start_at) AS end_at FROM ({address_sql(source_sql('planted_address'))}) GROUP BY doc_id) JOIN ({source_sql('planted_address')}) t USING (doc_id)) USING (doc_id)")(
    lambda s, d: texts(s, d, "planted_address").select("doc_id", inspection.mask(F.col("text"), R.addresses(F.col("text")), PEPPER).alias("masked"))
)

# inspection --------------------------------------------------------------------------------------------------------


def found_sql(src: str) -> str:
    """Findings of the scanners without keys: personal data, credentials, addresses."""
    return f"SELECT * FROM ({pii_sql(src)}) UNION ALL SELECT * FROM ({credentials_sql(src)}) UNION ALL SELECT * FROM ({address_sql(src)})"


KEY_RULES = (mnemonic_sql, hex_sql, solana_sql, substrate_sql, cardano_sql, keystore_sql, pem_sql)


def secrets_sql(src: str, rules: tuple = KEY_RULES) -> str:
    """Findings of the key rules that need no codec."""
    return " UNION ALL ".join(f"SELECT * FROM ({rule(src)})" for rule in rules)


def all_sql(src: str, rest: str | None = None, rules: tuple = KEY_RULES) -> str:
    """Findings that a decision rests on: a text with a certain key is searched no further."""
    return f"""WITH sec AS MATERIALIZED ({secrets_sql(src, rules)}), rest AS MATERIALIZED ({rest or found_sql(src)})
        SELECT * FROM sec UNION ALL SELECT * FROM rest WHERE doc_id NOT IN (SELECT doc_id FROM sec WHERE risk_level = 'CRITICAL')"""


def decisions_sql(src: str, direction: str = "USER_INPUT", values: str | None = None, rest: str | None = None) -> str:
    act = f"CASE WHEN risk_level = 'CRITICAL' AND entity_type IN ({', '.join(repr(k) for k in policy.KEYS)}) THEN 'BLOCK' ELSE coalesce(p.action, 'MASK') END"
    return f"""WITH f AS MATERIALIZED ({all_sql(src, rest)}), a AS (SELECT doc_id, {act} AS action FROM f LEFT JOIN (VALUES {values or _POLICY_VALUES}) AS p(pe, pd, action) ON pe = entity_type AND pd = '{direction}')
        SELECT d.doc_id, coalesce(arg_max(a.action, {_SEVERITY.replace("action", "a.action")}), 'ALLOW') AS action, count(a.doc_id) AS n_findings FROM ({src}) d LEFT JOIN a ON a.doc_id = d.doc_id GROUP BY d.doc_id"""


def masked_sql(src: str, decisions: str) -> str:
    """Sanitised texts: blocked ones replaced, of others each finding by its form; findings don't overlap here."""
    raw = "substr(text, start_at + 1, end_at - start_at)"
    form = f"""CASE WHEN entity_type IN ('ADDRESS', 'TX_HASH') THEN substr({raw}, 1, 6) || '...' || right({raw}, 4)
        WHEN entity_type = 'PII' THEN '[PII:' || CASE rule_id WHEN 'pii-email' THEN 'EMAIL' WHEN 'pii-cn-phone' THEN 'PHONE' WHEN 'pii-cn-id-card' THEN 'ID_CARD' ELSE 'BANK_CARD' END || ']'
        ELSE CASE WHEN entity_type IN ('API_KEY', 'PASSWORD', 'JWT') THEN '[SECRET:' ELSE '[BLOCKCHAIN_SECRET:' END || entity_type || ':' || substr({hmac_sql(raw)}, 1, 8) || ']' END"""
    return f"""WITH f AS MATERIALIZED ({all_sql(src)}), t AS MATERIALIZED ({src}), x AS MATERIALIZED ({decisions}),
        m AS (SELECT f.doc_id, string_agg(substr(text, before + 1, start_at - before) || {form}, '' ORDER BY start_at) AS body, max(end_at) AS last FROM (SELECT *, coalesce(lag(end_at) OVER (PARTITION BY doc_id ORDER BY start_at), 0) AS before FROM f) f JOIN t ON t.doc_id = f.doc_id GROUP BY f.doc_id)
        SELECT t.doc_id, action, CASE WHEN action = 'BLOCK' THEN '{inspection.BLOCKED}' WHEN action = 'ALLOW' OR body IS NULL THEN text ELSE body || substr(text, last + 1) END AS sanitized_text FROM t JOIN x ON x.doc_id = t.doc_id LEFT JOIN m ON m.doc_id = t.doc_id"""


def _unkeyed(text: Column) -> Column:
    """Findings of the scanners without keys; what the text holds at all is found once."""
    return spans.let(R.gates(text), lambda g: F.concat(R.pii(text, g["digits"]), R.credentials(text, g["named"], g["password"]), R.addresses(text, g["run"])))


def _decisions(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    return inspection.inspect(texts(spark, sf_dir, name), pepper=PEPPER, wordlist=syllable_wordlist(spark), **options)


for _name in ("documents", "pages", "planted_cred", "planted_pii", "planted_mixed"):
    query(f"inspect_{_name}", decisions_sql(source_sql(_name)))(lambda s, d, name=_name: _decisions(s, d, name).select("doc_id", "action", F.size("findings").cast("long").alias("n_findings")))

query("inspect_sanitized", f"SELECT doc_id, CASE action WHEN 'BLOCK' THEN '{inspection.BLOCKED}' ELSE text END AS sanitized_text, action = 'BLOCK' AS blocked FROM ({decisions_sql(source_sql('planted_cred'))}) JOIN ({source_sql('planted_cred')}) USING (doc_id)")(lambda s, d: _decisions(s, d, "planted_cred").select("doc_id", "sanitized_text", "blocked"))
_EVENTS = f"SELECT f.doc_id, entity_type, rule_id, risk_level, confidence, 'USER_INPUT' AS direction, source, CAST(NULL AS BIGINT) AS elapsed_ms, 'trace-' || d.doc_id AS trace_id, CAST(d.doc_id % 97 AS VARCHAR) AS conversation_id, CASE WHEN d.doc_id % 3 > 0 THEN 'user-' || d.doc_id % 3 END AS user_id, CAST(NULL AS VARCHAR) AS metadata_json, action, n_findings AS span_count, CAST(end_at - start_at AS INT) AS span_length, substr({hmac_sql('substr(text, start_at + 1, end_at - start_at)')}, 1, 8) AS fingerprint FROM ({all_sql(source_sql('documents'))}) f JOIN ({decisions_sql(source_sql('documents'))}) x ON f.doc_id = x.doc_id JOIN documents d ON d.doc_id = f.doc_id"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all documents, each text the request of a user and a conversation made from its id."""
    rows = texts(spark, sf_dir, "documents", "source")
    user = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("user-"), (F.col("doc_id") % 3).cast("string")))
    rows = inspection.with_context(rows, F.col("source"), F.concat(F.lit("trace-"), F.col("doc_id").cast("string")), F.col("doc_id") % 97, user)
    return inspection.audit_events(inspection.inspect(rows, pepper=PEPPER, wordlist=syllable_wordlist(spark)))


query("audit_events", _EVENTS)(lambda s, d: _events(s, d).drop("seq"))
_LINE_SQL = " || ".join(f"' {name}=' || coalesce(CAST({column} AS VARCHAR), 'null')" for name, column in (("direction", "direction"), ("source", "source"), ("entityType", "entity_type"), ("riskLevel", "risk_level"), ("action", "action"), ("ruleId", "rule_id"), ("fingerprint", "fingerprint"), ("spanCount", "span_count"), ("elapsedMs", "elapsed_ms"), ("traceId", "trace_id"), ("conversationId", "conversation_id"), ("userId", "user_id")))
query("audit_lines", f"WITH ev AS MATERIALIZED ({_EVENTS}) SELECT doc_id, 'guard-event' || {_LINE_SQL} AS line FROM ev")(lambda s, d: inspection.audit_lines(_events(s, d)).select("doc_id", "line"))

query("mask_persisted", masked_sql(source_sql("planted_mixed"), decisions_sql(source_sql("planted_mixed"), "TRACE_PERSIST")))(lambda s, d: _decisions(s, d, "planted_mixed", direction="TRACE_PERSIST").select("doc_id", "action", "sanitized_text"))
#: A policy of one's own: uncertain keys are masked, addresses reviewed; what it doesn't name falls back.
_OWN = [("PRIVATE_KEY_HEX", "USER_INPUT", "MASK"), ("ADDRESS", "USER_INPUT", "REVIEW"), ("PII", "USER_INPUT", "ALLOW")]
_OWN_SQL = decisions_sql(source_sql("planted_mixed"), values=", ".join(map(str, _OWN)))
query("own_policy", masked_sql(source_sql("planted_mixed"), _OWN_SQL))(
    lambda s, d: _decisions(s, d, "planted_mixed", policy=s.createDataFrame(_OWN, "entity_type string, direction string, action string")).select("doc_id", "action", "sanitized_text")
)
query("mixed_findings", all_sql(source_sql("planted_mixed")))(
    lambda s, d: spans.each(_decisions(s, d, "planted_mixed"), "findings", "doc_id").select("doc_id", "f.rule_id", "f.entity_type", "f.risk_level", "f.confidence", F.col("f.start").alias("start_at"), F.col("f.end").alias("end_at"))
)
#: A rule of one's own in place of that of hex keys.
_CUSTOMER = "Customer#[0-9]+"
query("own_rule", all_sql(source_sql("planted_mixed"), rules=(*(r for r in KEY_RULES if r is not hex_sql), lambda src: finding_sql(spans_sql(src, _CUSTOMER), "customer-name", "API_KEY", "HIGH", "0.8"))))(
    lambda s, d: spans.each(_decisions(s, d, "planted_mixed", skip=("evm-privkey-hex",), own={"customer-name": lambda t: F.transform(spans.regex_spans(t, _CUSTOMER), lambda x: spans.finding(x, "API_KEY", "HIGH", 0.8, "customer-name", "a customer's name"))}), "findings", "doc_id")
    .select("doc_id", "f.rule_id", "f.entity_type", "f.risk_level", "f.confidence", F.col("f.start").alias("start_at"), F.col("f.end").alias("end_at"))
)
#: Without personal data; windows of 2 turns.
_SETTINGS = settings.from_mapping({"pii": {"enabled": False}, "secret": {"hex-context-required": "false"}, "window": {"turns": "2"}})
query("settings_inspect", decisions_sql(source_sql("planted_mixed"), rest=f"SELECT * FROM ({credentials_sql(source_sql('planted_mixed'))}) UNION ALL SELECT * FROM ({address_sql(source_sql('planted_mixed'))})"))(
    lambda s, d: configured.inspect(texts(s, d, "planted_mixed"), _SETTINGS, wordlist=syllable_wordlist(s), pepper=PEPPER).select("doc_id", "action", F.size("findings").cast("long").alias("n_findings"))
)
_LIMIT = 40
query("scan_limit", decisions_sql(f"SELECT doc_id, substr(text, 1, {_LIMIT}) AS text FROM ({source_sql('planted_pii')})"))(lambda s, d: _decisions(s, d, "planted_pii", max_chars=_LIMIT).select("doc_id", "action", F.size("findings").cast("long").alias("n_findings")))
#: Types that a case expects, by the case's kind; where it expects none, nothing may be found.
_EXPECTED = {0: ["PRIVATE_KEY_HEX"], 1: ["PRIVATE_KEY_HEX", "PII"], 2: ["PEM_PRIVATE_KEY"], 3: ["MNEMONIC"], 4: ["ADDRESS", "PII"], 5: ["API_KEY"], 6: ["JWT"], 7: ["TX_HASH"], 8: []}
_EXPECTED_SQL = f"CASE doc_id % 9 {' '.join(f'WHEN {k} THEN {v}' for k, v in _EXPECTED.items() if v)} ELSE CAST([] AS VARCHAR[]) END"
query("acceptance_types", f"""WITH f AS MATERIALIZED (SELECT doc_id, list(DISTINCT entity_type) AS found FROM ({all_sql(source_sql('planted_mixed'))}) GROUP BY doc_id),
    c AS (SELECT doc_id % 9 AS kind, {_EXPECTED_SQL} AS expected, coalesce(found, CAST([] AS VARCHAR[])) AS found FROM ({source_sql('planted_mixed')}) LEFT JOIN f USING (doc_id))
    SELECT kind, count(*) AS cases, count(*) FILTER (CASE WHEN len(expected) = 0 THEN len(found) = 0 ELSE list_has_all(found, expected) END) AS passed FROM c GROUP BY kind""")(
    lambda s, d: _decisions(s, d, "planted_mixed").select((F.col("doc_id") % 9).alias("kind"), configured.holds(configured.found_types(F.col("findings")), _expected(F.col("doc_id") % 9)).alias("ok")).groupBy("kind").agg(F.count(F.lit(1)).alias("cases"), F.count_if("ok").alias("passed"))
)


def _expected(kind: Column) -> Column:
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for k, types in _EXPECTED.items():
        out = out.when(kind == k, F.array(*map(F.lit, types)).cast("array<string>"))
    return out


query("substrate_uri", substrate_sql(source_sql("planted_uri")))(lambda s, d: findings_of(texts(s, d, "planted_uri"), R.substrate_uri))
query("stellar_seeds", f"SELECT doc_id, 'STELLAR_SECRET_SEED' AS entity_type, 5 AS start_at, 61 AS end_at FROM ({source_sql('planted_stellar')}) WHERE text LIKE 'seed%' AND substr(text, 6, 56) = seed")(
    lambda s, d: spans.each(inspection.detect(texts(s, d, "planted_stellar")), "secrets", "doc_id").select("doc_id", "f.entity_type", F.col("f.start").alias("start_at"), F.col("f.end").alias("end_at"))
)
query("union_scanners", f"SELECT rule_id, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({found_sql(source_sql('documents'))}) GROUP BY rule_id")(
    lambda s, d: findings_of(texts(s, d, "documents"), _unkeyed).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))
)
query("findings_cube", f"SELECT rule_id, lang, count(*) AS n FROM ({found_sql(source_sql('documents'))}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY CUBE (rule_id, lang)")(
    lambda s, d: findings_of(texts(s, d, "documents", "lang"), _unkeyed).cube("rule_id", "lang").agg(F.count(F.lit(1)).alias("n"))
)
query("top_sources", f"SELECT source, count(*) AS n FROM ({found_sql(source_sql('documents'))}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY source ORDER BY n DESC, source LIMIT 5")(
    lambda s, d: findings_of(texts(s, d, "documents", "source"), _unkeyed).groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(5)
)
query("action_report", f"SELECT lang, count(*) FILTER (action = 'ALLOW') AS allowed, count(*) FILTER (action = 'MASK') AS masked, count(*) FILTER (action = 'BLOCK') AS blocked FROM ({decisions_sql(source_sql('documents'))}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang")(
    lambda s, d: inspection.inspect(texts(s, d, "documents", "lang"), pepper=PEPPER, wordlist=syllable_wordlist(s)).groupBy("lang").pivot("action", ["ALLOW", "MASK", "BLOCK"]).count().na.fill(0).select("lang", F.col("ALLOW").alias("allowed"), F.col("MASK").alias("masked"), F.col("BLOCK").alias("blocked"))
)

# mnemonics ---------------------------------------------------------------------------------------------------------

_WORD = "substr('bcdfghjklmnpqrst', k // 128 + 1, 1) || substr('aeio', (k // 32) % 4 + 1, 1) || substr('bdfgklmn', (k // 4) % 8 + 1, 1) || substr('aeio', k % 4 + 1, 1)"
_PHRASES = "(SELECT o_orderkey AS doc_id, [CAST((o_orderkey * 7919 + i * i * 131 + i * 17) % 2048 AS INT) FOR i IN generate_series(0, 11 + 3 * CAST(o_orderkey % 3 AS INT))] AS ks FROM orders)"


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase of 12, 15 or 18 list words for each order, after a line of other words."""
    rows = dealt(table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("doc_id"), F.expr("transform(sequence(0, 11 + 3 * cast(o_orderkey % 3 as int)), i -> cast((o_orderkey * 7919 + i * i * 131 + i * 17) % 2048 as int))").alias("ks"))
    word = "concat(substr('bcdfghjklmnpqrst', k div 128 + 1, 1), substr('aeio', (k div 32) % 4 + 1, 1), substr('bdfgklmn', (k div 4) % 8 + 1, 1), substr('aeio', k % 4 + 1, 1))"
    return rows.select("doc_id", F.expr(f"concat('zzzz QQQ text ', array_join(transform(ks, k -> {word.replace('k div', 'cast(k as bigint) div').replace('substr(', 'substring(')}), ' '))").alias("text"))


def _han_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12 to 20 list characters for each order after three letters."""
    signs = F.transform(F.sequence(F.lit(0), (11 + F.col("o_orderkey") % 9).cast("int")), lambda i: F.decode(F.unhex(F.hex(((F.lit(0x4E00) + (F.col("o_orderkey") * 31 + i * 7) % 2048).cast("int")))), "UTF-16BE"))
    return dealt(table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("abc"), F.array_join(signs, ""), F.lit(" end")).alias("text"))


query("bip39_runs", "SELECT doc_id, CAST(len(ks) AS BIGINT) AS n, CAST(14 AS INT) AS start_at, CAST(14 + 5 * len(ks) - 1 AS INT) AS end_at FROM " + _PHRASES)(
    lambda s, d: mnemonics.runs(_phrases(s, d), syllable_wordlist(s)).select(F.col("id").alias("doc_id"), "n", F.get("words", F.lit(0))["start"].alias("start_at"), F.get("words", F.size("words") - 1)["end"].alias("end_at"))
)
_WINDOWS = f"(SELECT doc_id, c, p, w, {_BITS} AS bits, c * 11 // 33 AS check_bits FROM (SELECT doc_id, c, p, ks[p + 1 : p + c] AS w FROM (SELECT doc_id, ks, c, unnest(generate_series(0, len(ks) - c)) AS p FROM (SELECT doc_id, ks, unnest([12, 15, 18, 21, 24]) AS c FROM {_PHRASES}) WHERE len(ks) >= c)))"
_DIGEST_BITS = "lpad(bin(CAST(('0x' || substr(digest, 1, 2)) AS INT)), 8, '0')"
query("bip39_checksum", f"SELECT doc_id, CAST(14 + 5 * p AS INT) AS start_at, CAST(14 + 5 * (p + c) - 1 AS INT) AS end_at, CAST(c AS INT) AS n_words, 'CRITICAL' AS risk_level FROM (SELECT *, sha256({_ENTROPY}) AS digest FROM {_WINDOWS}) WHERE substr({_DIGEST_BITS}, 1, check_bits) = right(bits, check_bits)")(
    lambda s, d: mnemonics.mnemonics(_phrases(s, d), syllable_wordlist(s)).select(F.col("id").alias("doc_id"), F.col("start").alias("start_at"), F.col("end").alias("end_at"), "n_words", "risk_level")
)


#: Phrases of the orders with junctions after them; of every seventh the first word is no word of the list, of every fifth a space is missing before the junctions' word.
_URI_TAIL = "CASE o_orderkey % 3 WHEN 0 THEN '//hard/soft' WHEN 1 THEN '/soft///pass word' ELSE ' //apart' END"
_URI = "(?:[bcdfghjklmnpqrst][aeio][bdfgklmn][aeio]\\s)"


def _phrase_uri_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderkey", F.expr(_URI_TAIL).alias("tail"))
    changed = F.expr("case when doc_id % 7 = 0 then replace(text, ' text ', ' text x') when doc_id % 5 = 0 then concat(left(text, length(text) - 5), right(text, 4)) else text end")
    return _phrases(spark, sf_dir).join(tails, "doc_id").select("doc_id", F.concat(changed, F.col("tail"), F.lit(" end")).alias("text"))


def _phrase_uri_sql() -> str:
    phrase = f"'zzzz QQQ text ' || list_aggregate([{_WORD} FOR k IN ks], 'string_agg', ' ')"
    changed = "CASE WHEN doc_id % 7 = 0 THEN replace(t, ' text ', ' text x') WHEN doc_id % 5 = 0 THEN left(t, length(t) - 5) || right(t, 4) ELSE t END"
    src = f"SELECT doc_id, {changed} || {_URI_TAIL} || ' end' AS text FROM (SELECT doc_id, {phrase} AS t FROM {_PHRASES}) JOIN (SELECT o_orderkey FROM orders) ON o_orderkey = doc_id"
    # words before the junctions, then each allowed length of their end
    found = spans_sql(src, f"(^|\\s)({_URI}*[bcdfghjklmnpqrst][aeio][bdfgklmn][aeio](//?[^/\\s]+)+(///[^\\s]+)?)", 2)
    words = f"SELECT doc_id, e, e - length(v) AS s0, [{_SYLLABLES} FOR v IN string_split(regexp_extract(v, '^[^/]+'), ' ')] AS ks FROM {found}"
    cut = f"SELECT doc_id, e, c, s0 + 5 * (len(ks) - c) AS s, ks[len(ks) - c + 1 :] AS w, c * 11 // 33 AS check_bits FROM (SELECT *, unnest([12, 15, 18, 21, 24]) AS c FROM ({words})) WHERE len(ks) >= c"
    digest = "substr(lpad(bin(CAST(('0x' || substr(digest, 1, 2)) AS INT)), 8, '0'), 1, check_bits)"
    return f"""WITH b AS (SELECT *, {_BITS} AS bits FROM ({cut})), d AS (SELECT *, sha256({_ENTROPY}) AS digest FROM b)
        SELECT doc_id, CAST(min(s) AS INT) AS start_at, CAST(e AS INT) AS end_at FROM d WHERE {digest} = right(bits, check_bits) GROUP BY doc_id, e"""


query("substrate_phrases", _phrase_uri_sql())(
    lambda s, d: _phrase_uri_texts(s, d).select("doc_id", F.explode(mnemonics.phrase_uris(F.col("text"), mnemonics.word_table(syllable_wordlist(s), "english"))).alias("f")).select("doc_id", F.col("f.start").alias("start_at"), F.col("f.end").alias("end_at"))
)

#: Ids that are null or shared: a third of the texts has none, and another third that of the text before it.
query("mnemonic_any_id", f"SELECT md5(text) AS text_md5, action, n_findings FROM ({decisions_sql(source_sql('planted_mixed'))}) JOIN ({source_sql('planted_mixed')}) USING (doc_id)")(
    lambda s, d: inspection.inspect(texts(s, d, "planted_mixed").withColumn("doc_id", F.expr("case doc_id % 3 when 0 then null when 1 then doc_id - 1 else doc_id end")), pepper=PEPPER, wordlist=syllable_wordlist(s)).select(F.md5("text").alias("text_md5"), "action", F.size("findings").cast("long").alias("n_findings"))
)

# conversations and structured texts --------------------------------------------------------------------------------

_NORM = "trim(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g'))"
query("conversation_windows", f"SELECT conv_id, turn, string_agg(norm, ' ' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS window_text FROM (SELECT conv_id, turn, {_NORM} AS norm FROM conversations WHERE role = 'user') WHERE norm <> ''".replace("string_agg(norm, ' ' ORDER BY turn)", "string_agg(norm, ' ')"))(
    lambda s, d: conversations.windows(table(s, d, "conversations").where("role = 'user'")).select("conv_id", "turn", F.col("window").alias("window_text"))
)
_USER_TURNS = f"SELECT conv_id, turn, {_NORM} AS norm FROM conversations WHERE role = 'user'"
query("conversation_ttl", f"""SELECT conv_id, turn, concat_ws(' ', CASE WHEN turn - t2 < 3 THEN n2 END, CASE WHEN turn - t1 < 3 THEN n1 END, norm) AS window_text FROM (
    SELECT *, lag(norm, 1) OVER w AS n1, lag(turn, 1) OVER w AS t1, lag(norm, 2) OVER w AS n2, lag(turn, 2) OVER w AS t2 FROM ({_USER_TURNS}) WHERE norm <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""")(
    lambda s, d: conversations.windows(table(s, d, "conversations").where("role = 'user'").withColumn("at", F.timestamp_seconds(F.col("turn") * 600)), ttl=1800, ts="at").select("conv_id", "turn", F.col("window").alias("window_text"))
)
query("conversation_cap", "SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS n_turns FROM (SELECT CAST(o_orderkey % 10 AS VARCHAR) AS conv_id, o_orderkey AS turn FROM orders)")(
    lambda s, d: conversations.windows(table(s, d, "orders").select((F.col("o_orderkey") % 10).cast("string").alias("conv_id"), F.col("o_orderkey").alias("turn"), F.lit("word").alias("text")), n=500).select("conv_id", "turn", F.size(F.split("window", " ")).cast("long").alias("n_turns"))
)
query("json_whole_texts", "SELECT doc_id, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS key, coalesce(text, '') AS value, 0 AS value_start, CAST(length(coalesce(text, '')) AS INT) AS value_end FROM documents")(
    lambda s, d: structured.extract_fields(texts(s, d, "documents"), text="text").withColumnRenamed("id", "doc_id")
)
query("han_runs", "SELECT o_orderkey AS doc_id, CAST(12 + o_orderkey % 9 AS BIGINT) AS n, 3 AS start_at, CAST(3 + 12 + o_orderkey % 9 AS INT) AS end_at FROM orders")(
    lambda s, d: mnemonics.runs(_han_texts(s, d), han_wordlist(s), "chinese", least=12).select(F.col("id").alias("doc_id"), "n", F.get("words", F.lit(0))["start"].alias("start_at"), F.get("words", F.size("words") - 1)["end"].alias("end_at"))
)
query("mnemonic_languages", f"SELECT doc_id, start_at, end_at, risk_level FROM ({mnemonic_sql(source_sql('planted_mixed'))})")(
    lambda s, d: mnemonics.mnemonics(texts(s, d, "planted_mixed"), syllable_wordlist(s).unionByName(han_wordlist(s)), ("english", "chinese")).select(F.col("id").alias("doc_id"), F.col("start").alias("start_at"), F.col("end").alias("end_at"), "risk_level")
)
query("cross_turn_block", f"""WITH t AS ({planted_sql("planted_turns")}), k AS (SELECT conv_id, count(DISTINCT turn) FILTER (turn <= 3) AS parts FROM t GROUP BY conv_id)
    SELECT conv_id, turn, (turn = 3 AND parts = 3 AND sha256(conv_id) BETWEEN '{crypto.SECP256K1_FIRST}' AND '{crypto.SECP256K1_LAST}') AS blocked, CASE WHEN turn = 3 AND parts = 3 THEN 'PRIVATE_KEY_HEX' ELSE '' END AS entities FROM t JOIN k USING (conv_id)""")(
    lambda s, d: conversations.cross_turn(planted(s, d, "planted_turns")).select("conv_id", "turn", "blocked", F.array_join("critical_entities", ",").alias("entities"))
)
_PREFIX = "length('{\"part\":{\"name\":\"')"
query("json_fields", f"""SELECT doc_id, path, key, value, CAST(s AS INT) AS value_start, CAST(s + length(value) AS INT) AS value_end FROM (
    SELECT p_partkey AS doc_id, 'part.name' AS path, 'name' AS key, p_name AS value, {_PREFIX} AS s FROM part
    UNION ALL SELECT p_partkey, 'tags[0]', NULL, p_brand, {_PREFIX} + length(p_name) + length('","size":') + length(CAST(p_size AS VARCHAR)) + length('}},"tags":["') FROM part
    UNION ALL SELECT p_partkey, 'tags[1]', NULL, p_type, {_PREFIX} + length(p_name) + length('","size":') + length(CAST(p_size AS VARCHAR)) + length('}},"tags":["') + length(p_brand) + length('","') FROM part
    UNION ALL SELECT p_partkey, 'private_key', 'private_key', sha256(CAST(p_partkey AS VARCHAR)), {_PREFIX} + length(p_name) + length('","size":') + length(CAST(p_size AS VARCHAR)) + length('}},"tags":["') + length(p_brand) + length('","') + length(p_type) + length('"],"private_key":"') FROM part)""")(
    lambda s, d: structured.extract_fields(planted(s, d, "planted_json")).withColumnRenamed("id", "doc_id")
)
query("json_secret_scan", f"""SELECT doc_id, 'private_key' AS path, 'PRIVATE_KEY_HEX' AS entity_type, 'CRITICAL' AS risk_level, CAST(length(json) - 66 AS INT) AS start_at, CAST(length(json) - 2 AS INT) AS end_at FROM ({planted_sql("planted_json")}) WHERE substr(json, length(json) - 65, 64) BETWEEN '{crypto.SECP256K1_FIRST}' AND '{crypto.SECP256K1_LAST}'""")(
    lambda s, d: structured.json_secrets(planted(s, d, "planted_json")).select(F.col("id").alias("doc_id"), "path", "entity_type", "risk_level", F.col("start").alias("start_at"), F.col("end").alias("end_at"))
)

# providers: entities as a service would send them, derived from the rows ---------------------------------------------

_TYPE_NAMES = ["PERSON", "CREDIT_CARD", "LOCATION", "HOBBY"]


def _entities() -> Column:
    kind = F.get(F.array(*map(F.lit, _TYPE_NAMES)), (F.col("doc_id") % 4).cast("int"))
    return F.array(F.struct(kind.alias("type"), (F.col("doc_id") % 11 - 1).cast("int").alias("start"), (F.col("doc_id") % 23).cast("int").alias("end"), ((F.col("doc_id") % 10) / 10).cast("double").alias("score"))).cast(providers.ENTITIES)


_STUB = "SELECT doc_id, text, ['PERSON', 'CREDIT_CARD', 'LOCATION', 'HOBBY'][1 + CAST(doc_id % 4 AS INT)] AS type, CAST(doc_id % 11 - 1 AS INT) AS s0, CAST(doc_id % 23 AS INT) AS e0, (doc_id % 10) / 10.0 AS score FROM documents"
query("provider_pii", f"SELECT doc_id, 'pii-presidio:' || type AS rule_id, 'PII' AS entity_type, CASE WHEN type = 'CREDIT_CARD' THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level, CAST(score AS DOUBLE) AS confidence, s0 AS start_at, e0 AS end_at FROM ({_STUB}) WHERE score >= 0.5 AND type <> 'HOBBY' AND s0 >= 0 AND s0 < e0 AND e0 <= length(text)")(
    lambda s, d: texts(s, d, "documents").select("doc_id", F.explode(providers.pii_findings(F.col("text"), _entities())).alias("f")).select("doc_id", "f.rule_id", "f.entity_type", "f.risk_level", "f.confidence", F.col("f.start").alias("start_at"), F.col("f.end").alias("end_at"))
)
query("provider_injection", f"SELECT doc_id, 'injection-llmguard:' || type AS rule_id, 'PROMPT_INJECTION' AS entity_type, 'HIGH' AS risk_level, CAST(score AS DOUBLE) AS confidence, CAST(greatest(s0, 0) AS INT) AS start_at, CAST(least(CASE WHEN e0 <= greatest(s0, 0) THEN length(text) ELSE e0 END, length(text)) AS INT) AS end_at FROM ({_STUB}) WHERE score >= 0.5")(
    lambda s, d: texts(s, d, "documents").select("doc_id", F.explode(providers.injection_findings(F.col("text"), _entities())).alias("f")).select("doc_id", "f.rule_id", "f.entity_type", "f.risk_level", "f.confidence", F.col("f.start").alias("start_at"), F.col("f.end").alias("end_at"))
)
_ANSWER = """CASE c_custkey % 4 WHEN 0 THEN concat('{"is_valid": false, "scanners": {"Toxicity": 0.', CAST(c_custkey % 10 AS VARCHAR(9)), '}, "sanitized_prompt": "', c_name, '"}')
    WHEN 1 THEN concat('{"is_valid": true, "scanners": {}, "sanitized_prompt": "', c_mktsegment, '"}') WHEN 2 THEN '{"scanners": {"Secrets": 1.0}}' ELSE 'no answer' END"""
query("provider_verdicts", "SELECT c_custkey, c_custkey % 4 <> 0 AS valid, CASE c_custkey % 4 WHEN 0 THEN (c_custkey % 10) / 10.0 WHEN 2 THEN 1.0 END AS worst, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment END AS sanitized FROM customer")(
    lambda s, d: table(s, d, "customer").select("c_custkey", providers.verdicts(F.expr(_ANSWER)).alias("v")).select("c_custkey", "v.valid", F.array_max(F.map_values("v.scanners")).alias("worst"), "v.sanitized")
)
query("provider_thresholds", "SELECT c_custkey, name, CAST(score AS DOUBLE) AS score FROM (SELECT c_custkey, 'balance' AS name, (c_custkey % 100) / 100.0 AS score FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey / 25.0 FROM customer) WHERE score >= 0.6")(
    lambda s, d: table(s, d, "customer").select("c_custkey", F.explode(providers.threshold_scanners(F.create_map(F.lit("balance"), (F.col("c_custkey") % 100) / 100, F.lit("nation"), F.col("c_nationkey") / 25), 0.6)).alias("e")).select("c_custkey", F.col("e.type").alias("name"), F.col("e.score").alias("score"))
)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: decisions and sanitised texts for all documents."""
    out = _decisions(spark, sf_dir, "documents")
    return out.select("doc_id", "action", F.size("findings").alias("n_findings"), "sanitized_text")
_PROPS = source_sql("planted_props")
#: json_valid lets trailing commas pass.
_FIELD_TERMS = lambda terms: "(" + " OR ".join(f"contains(line, '{t}')" for t in terms) + ")"
query("inspect_json", f"""WITH k AS (SELECT doc_id, text, v, s, e, lower(regexp_replace(regexp_extract(substr(text, 1, CAST(s - 1 AS BIGINT)), '"([^"]*)"\\s*:\\s*$', 1), '[_.-]', ' ', 'g')) || ': ' || v AS line FROM {spans_sql(_PROPS, R.HEX64)} WHERE json_valid(text) AND NOT regexp_matches(text, ',\\s*[}}\\]]')),
    g AS (SELECT *, CASE WHEN {_FIELD_TERMS(R.KEY_TERMS)} AND {VALID_SQL} THEN 3 WHEN {_FIELD_TERMS(R.KEY_TERMS)} THEN 2 WHEN {_FIELD_TERMS(R.NOT_KEY_TERMS)} OR NOT ({VALID_SQL}) THEN 0 ELSE 1 END AS grade FROM k),
    a AS (SELECT doc_id, CASE grade WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level, CAST(s AS INT) AS start_at, CAST(e AS INT) AS end_at FROM g WHERE grade > 0 UNION ALL SELECT doc_id, risk_level, start_at, end_at FROM ({hex_sql(_PROPS)}))
    SELECT doc_id, 'PRIVATE_KEY_HEX' AS entity_type, arg_max(risk_level, {_RISK_SQL}) AS risk_level, min(start_at) AS start_at, max(end_at) AS end_at FROM a GROUP BY doc_id""")(
    lambda s, d: _exploded(_decisions(s, d, "planted_props"), F.col("findings"))
)

#: Cases by the kind of a text: what is expected of it. Every fifth says that it is a known gap, every seventh is deferred.
_ACTIONS = {0: "BLOCK", 1: "MASK", 2: "BLOCK", 3: "BLOCK", 4: "MASK", 5: "BLOCK", 6: "BLOCK", 7: "ALLOW", 8: "ALLOW"}
_BY_KIND = "CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN '{a}'" for k, a in _ACTIONS.items()) + " END"
_MIXED = source_sql("planted_mixed")
_PASSES = "action = wanted AND CASE WHEN len(expected) = 0 THEN len(found) = 0 ELSE list_has_all(found, expected) END AND n_findings >= doc_id % 2 AND NOT contains(sanitized_text, '@example.com')"


@query("acceptance_report", f"""WITH s AS MATERIALIZED ({decisions_sql(_MIXED)}), m AS MATERIALIZED ({masked_sql(_MIXED, decisions_sql(_MIXED))}), f AS (SELECT doc_id, list(DISTINCT entity_type) AS found FROM ({all_sql(_MIXED)}) GROUP BY doc_id),
    c AS (SELECT s.doc_id, s.action, n_findings, sanitized_text, coalesce(found, CAST([] AS VARCHAR[])) AS found, {_EXPECTED_SQL.replace("doc_id", "s.doc_id")} AS expected, {_BY_KIND.replace("doc_id", "s.doc_id")} AS wanted FROM s JOIN m USING (doc_id) LEFT JOIN f USING (doc_id)),
    b AS (SELECT 'kind ' || doc_id % 9 AS category, CASE WHEN doc_id % 7 = 0 THEN 'SKIPPED' WHEN {_PASSES} THEN 'PASS' WHEN doc_id % 5 = 0 THEN 'KNOWN_GAP_FAIL' ELSE 'REGRESSION_FAIL' END AS bucket FROM c)
    SELECT category, {", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}" for b in acceptance.BUCKETS)} FROM b GROUP BY category""")
def acceptance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases made of the planted texts, written as files, read, run and counted."""
    case = F.struct(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("kind "), F.col("doc_id") % 9).alias("category"), F.lit("USER_INPUT").alias("direction"), F.lit("planted").alias("sampleSource"),
        F.when(F.col("doc_id") % 7 == 0, "deferred-later").otherwise(F.expr(_BY_KIND)).alias("expectedAction"), _expected(F.col("doc_id") % 9).alias("expectedEntityTypes"), (F.col("doc_id") % 2).cast("int").alias("expectedMinFindings"),
        F.array(F.lit("@example.com")).alias("mustNotResidual"), F.when(F.col("doc_id") % 5 == 0, "known").alias("knownGap"), F.col("text").alias("input"),
    )
    at = shared_folder(spark, "cases")
    texts(spark, sf_dir, "planted_mixed").groupBy((F.col("doc_id") % 50).alias("file")).agg(F.collect_list(case).alias("cases")).select("cases").write.json(at)
    results = acceptance.run_cases(acceptance.read_cases(spark, at, lines=True), syllable_wordlist(spark), PEPPER)
    return acceptance.report(results)

# streams -----------------------------------------------------------------------------------------------------------

_ALL_TURNS = f"SELECT conv_id, turn, {_NORM} AS norm FROM conversations"


@query("conversation_stream", f"""SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn, concat_ws(' ', CASE WHEN turn - t2 < 3 THEN n2 END, CASE WHEN turn - t1 < 3 THEN n1 END, norm) AS window_text FROM (
    SELECT *, lag(norm, 1) OVER w AS n1, lag(turn, 1) OVER w AS t1, lag(norm, 2) OVER w AS n2, lag(turn, 2) OVER w AS t2 FROM ({_ALL_TURNS}) WHERE norm <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""")
def conversation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all turns from a stream of the table; a turn is ten minutes after the one before it, and expires after thirty."""
    # a pattern, since a stream takes a folder or a pattern, and the table may be one file
    turns = spark.readStream.schema(table(spark, sf_dir, "conversations").schema).parquet(f"{sf_dir}/conversation[s].parquet")
    turns = turns.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "text", F.timestamp_seconds(F.col("turn") * 600).alias("at"))
    rows = stream.windows(turns, ttl=1800, ts="at", drop_idle=False)
    return stream.run_available(rows, shared_folder(spark, "turns")).select("conv_id", "turn", F.col("window").alias("window_text"))


#: Turns ten minutes apart; every fifth comes twelve minutes after its time, every seventh fifty. They may be 15 minutes old.
_SHIFT = "CASE WHEN (conv_id + turn) % 7 = 0 THEN 3000 WHEN (conv_id + turn) % 5 = 0 THEN 720 ELSE 0 END"
_LATE, _TTL = 900, 1800


@query("conversation_late", f"""WITH t AS (SELECT conv_id, turn, norm, turn * 600 - {_SHIFT} AS ts FROM ({_ALL_TURNS}) WHERE norm <> ''),
    l AS (SELECT *, coalesce(ts < max(ts) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {_LATE}, false) AS late FROM t),
    p AS (SELECT x.conv_id, x.turn, y.norm, y.ts, y.turn AS n, row_number() OVER (PARTITION BY x.conv_id, x.turn ORDER BY y.ts DESC, y.turn DESC) AS back FROM l x JOIN l y ON x.conv_id = y.conv_id AND y.turn <= x.turn AND (y.ts < x.ts OR (y.ts = x.ts AND y.turn <= x.turn)) AND NOT x.late AND NOT y.late
        QUALIFY back <= 3 AND y.ts > x.ts - {_TTL})
    SELECT CAST(l.conv_id AS VARCHAR) AS conv_id, l.turn, late, string_agg(p.norm, ' ' ORDER BY p.ts, p.n) AS window_text FROM l LEFT JOIN p ON l.conv_id = p.conv_id AND l.turn = p.turn GROUP BY ALL""")
def conversation_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns out of order and too late, in three batches: a turn's window, or that it is late."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.expr(f"timestamp_seconds(turn * 600 - {_SHIFT})").alias("at"))
    turns = turns.withColumn("conv_id", F.col("conv_id").cast("string"))
    at = shared_folder(spark, "late")
    for those in ("turn < 3", "turn between 3 and 5", "turn > 5"):
        # a run takes what is new as one batch, in however many files a large table is written
        turns.where(those).write.mode("append").parquet(f"{at}/in")
        rows = stream.timed_windows(spark.readStream.schema(turns.schema).parquet(f"{at}/in"), ttl=_TTL, ts="at", delay=_LATE, drop_idle=False)
        found = stream.run_available(rows, at)
    return found.select("conv_id", "turn", "late", F.col("window").alias("window_text"))


@query("audit_log", f"WITH f AS MATERIALIZED ({all_sql(source_sql('planted_mixed'))}), x AS MATERIALIZED ({decisions_sql(source_sql('planted_mixed'))}) SELECT CAST(doc_id % 3 AS BIGINT) AS batch, rule_id, action, count(*) AS n_events, CAST(sum(n_findings) AS BIGINT) AS spans FROM f JOIN x USING (doc_id) GROUP BY ALL")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of three batches, the second of which is written twice, read back from the log."""
    rows, log = texts(spark, sf_dir, "planted_mixed"), AuditLog(f"{shared_folder(spark, 'audit')}/events")
    each = stream.inspect_batches(lambda _: None, log, pepper=PEPPER, wordlist=syllable_wordlist(spark))
    for number in (0, 1, 1, 2):
        each(rows.where(F.col("doc_id") % 3 == number), number)
    return log.read(spark).groupBy("batch", "rule_id", "action").agg(F.count(F.lit(1)).alias("n_events"), F.sum("span_count").alias("spans"))

"""Texts with planted findings, derived from the keys of the given tables, the same in Spark and in SQL.

Each relation has a Spark builder and the SQL of the same rows for DuckDB.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .tables import dealt, table

#: By name: SQL that both engines run. {sha} is the engine's hex SHA-256 of a text.
RELATIONS = {
    # hexadecimal keys: labelled, hashed, bare, out of range
    "planted_hex": """SELECT o_orderkey AS doc_id, CASE o_orderkey % 6
        WHEN 0 THEN concat('private key: 0x', {sha:CAST(o_orderkey AS VARCHAR(20))})
        WHEN 1 THEN concat('tx_hash: 0x', {sha:CAST(o_orderkey AS VARCHAR(20))})
        WHEN 2 THEN concat('value ', {sha:CAST(o_orderkey AS VARCHAR(20))}, ' end')
        WHEN 3 THEN concat('wallet key ', repeat('f', 64))
        WHEN 4 THEN concat('use ed25519-priv-0x', {sha:CAST(o_orderkey AS VARCHAR(20))}, ' here')
        ELSE concat('order ', CAST(o_orderkey AS VARCHAR(20)), ' is plain text') END AS text FROM orders""",
    # public identifiers
    "planted_address": """SELECT c_custkey AS doc_id, CASE c_custkey % 4
        WHEN 0 THEN concat('send to 0x', substr({sha:CAST(c_custkey AS VARCHAR(20))}, 1, 40), '!')
        WHEN 1 THEN concat('tx 0x', {sha:CAST(c_custkey AS VARCHAR(20))}, ' mined')
        WHEN 2 THEN concat('odd 0x', substr({sha:CAST(c_custkey AS VARCHAR(20))}, 1, 50), '.')
        ELSE concat('pay 1', translate(substr({sha:CAST(c_custkey AS VARCHAR(20))}, 1, 30), '0', 'z'), ' now') END AS text FROM customer""",
    # personal data: e-mail addresses, phone numbers, identity numbers and cards with right and wrong checks
    "planted_pii": """SELECT c_custkey AS doc_id, CASE c_custkey % 5
        WHEN 0 THEN concat('mail user', CAST(c_custkey AS VARCHAR(20)), '@example.com or call 1', CAST(3 + c_custkey % 7 AS VARCHAR(20)), lpad(CAST(c_custkey AS VARCHAR(20)), 9, '0'))
        WHEN 1 THEN concat('phone +1', CAST(3 + c_custkey % 7 AS VARCHAR(20)), lpad(CAST(c_custkey AS VARCHAR(20)), 9, '0'), '.')
        WHEN 2 THEN concat('card 411111', lpad(CAST(c_custkey AS VARCHAR(20)), 10, '0'), ' ok')
        WHEN 3 THEN concat('id 110101199003', lpad(CAST(1 + c_custkey % 28 AS VARCHAR(20)), 2, '0'), lpad(CAST(c_custkey % 1000 AS VARCHAR(20)), 3, '0'), substr('10X98765432', CAST(1 + c_custkey % 11 AS INT), 1), ';')
        ELSE concat('nothing here ', c_name) END AS text FROM customer""",
    # credentials
    "planted_cred": """SELECT s_suppkey AS doc_id, CASE s_suppkey % 5
        WHEN 0 THEN concat('ghp_', substr({sha:CAST(s_suppkey AS VARCHAR(20))}, 1, 36), ' leaked')
        WHEN 1 THEN concat('key AKIA', upper(substr({sha:CAST(s_suppkey AS VARCHAR(20))}, 1, 16)), ' x')
        WHEN 2 THEN concat('api_key = ', substr({sha:CAST(s_suppkey AS VARCHAR(20))}, 1, 40), ' x')
        WHEN 3 THEN concat('token: ', repeat(substr({sha:CAST(s_suppkey AS VARCHAR(20))}, 1, 2), 10), ' x')
        ELSE concat('password = pw', CAST(s_suppkey AS VARCHAR(20)), 'secret x') END AS text FROM supplier""",
    # turns of conversations with a key in parts
    "planted_turns": """SELECT DISTINCT CAST(l_orderkey AS VARCHAR(20)) AS conv_id, CAST(l_linenumber AS BIGINT) AS turn, CASE l_linenumber
        WHEN 1 THEN concat('private key 0x', substr({sha:CAST(l_orderkey AS VARCHAR(20))}, 1, 20))
        WHEN 2 THEN substr({sha:CAST(l_orderkey AS VARCHAR(20))}, 21, 20)
        WHEN 3 THEN substr({sha:CAST(l_orderkey AS VARCHAR(20))}, 41, 24)
        ELSE concat('that is all, thanks! ', CAST(l_linenumber AS VARCHAR(20))) END AS text FROM lineitem""",
    # JSON of a fixed shape
    "planted_json": """SELECT p_partkey AS doc_id, concat('{"part":{"name":"', p_name, '","size":', CAST(p_size AS VARCHAR(20)), '},"tags":["', p_brand, '","', p_type, '"],"private_key":"', {sha:CAST(p_partkey AS VARCHAR(20))}, '"}') AS json FROM part""",
    # PEM, keystore, key envelope and byte array
    "planted_files": """SELECT s_suppkey AS doc_id, CASE s_suppkey % 5
        WHEN 0 THEN concat('see -----BEGIN EC PRIVATE KEY-----', chr(10), {sha:CAST(s_suppkey AS VARCHAR(20))}, chr(10), '-----END EC PRIVATE KEY----- done')
        WHEN 1 THEN concat('file {"address":"', s_name, '","crypto":{"cipher":"a","ciphertext":"b","kdf":"c","mac":"d"},"version":3} end')
        WHEN 2 THEN concat('{"type":"PaymentSigningKeyShelley_ed25519","description":"', s_name, '","cborHex":"5820"}')
        WHEN 3 THEN concat('solana [', repeat(concat(CAST(s_suppkey % 300 AS VARCHAR(20)), ', '), 63), '7] id.json')
        ELSE concat('-----BEGIN PUBLIC KEY----- ', s_name) END AS text FROM supplier""",
    # keys, credentials, personal data and addresses in one text; letters only in the hex, so that no number stands in a key by chance
    "planted_mixed": """SELECT c_custkey AS doc_id, CASE c_custkey % 9
        WHEN 0 THEN concat('private key: 0x', translate({sha:CAST(c_custkey AS VARCHAR(20))}, '0123456789', 'abcdefabcd'), ' call 13800000000')
        WHEN 1 THEN concat('value ', translate({sha:CAST(c_custkey AS VARCHAR(20))}, '0123456789', 'abcdefabcd'), ' end, mail user', CAST(c_custkey AS VARCHAR(20)), '@example.com')
        WHEN 2 THEN concat('password = pw', CAST(c_custkey AS VARCHAR(20)), ' -----BEGIN PRIVATE KEY----- x -----END PRIVATE KEY-----')
        WHEN 3 THEN concat('mail a@example.com, seed phrase: ', {phrase}, ' .')
        WHEN 4 THEN concat('pay 0x', substr(translate({sha:CAST(c_custkey AS VARCHAR(20))}, '0123456789', 'abcdefabcd'), 1, 40), ' or call 13912345678!')
        WHEN 5 THEN concat('use sk-proj_', substr(translate({sha:CAST(c_custkey AS VARCHAR(20))}, '0123456789', 'abcdefabcd'), 1, 20), 'T3BlbkFJ', substr(translate({sha:CAST(c_custkey AS VARCHAR(20))}, '0123456789', 'abcdefabcd'), 21, 20), ' now, mail b@example.com')
        WHEN 6 THEN concat('bearer eyJ', substr(translate({sha:CAST(c_custkey AS VARCHAR(20))}, '0123456789', 'abcdefabcd'), 1, 20), '.eyJ', substr(translate({sha:CAST(c_custkey AS VARCHAR(20))}, '0123456789', 'abcdefabcd'), 21, 20), '.', substr(translate({sha:CAST(c_custkey AS VARCHAR(20))}, '0123456789', 'abcdefabcd'), 41, 20), ' from 13800138000')
        WHEN 7 THEN concat('maps AIza', substr(translate({sha:CAST(c_custkey AS VARCHAR(20))}, '0123456789', 'abcdefabcd'), 1, 35), ' and tx 0x', translate({sha:c_name}, '0123456789', 'abcdefabcd'), ' tx_hash')
        ELSE concat('words ', {phrase}, ' only, ', c_name) END AS text FROM customer""",
    # JSON: nested, escaped, with a trailing comma, a name that speaks against a key, inside other text, in an array
    "planted_props": """SELECT p_partkey AS doc_id, CASE p_partkey % 6
        WHEN 0 THEN concat('{"part":{"name":"', p_name, '","keys":[{"private_key" : "', {hex}, '"}]},"n":1}')
        WHEN 1 THEN concat('{"note":"a ', chr(92), '"quoted', chr(92), '" {brace}","wallet-key":"0x', {hex}, '"}')
        WHEN 2 THEN concat('{"private_key":"', {hex}, '",}')
        WHEN 3 THEN concat('{"tx_hash":"', {hex}, '"}')
        WHEN 4 THEN concat('see {"private_key":"', {hex}, '"} here')
        ELSE concat('["x", 12, {"secret key":"', {hex}, '"}]') END AS text FROM part""",
    # seeds with derivation junctions
    "planted_uri": """SELECT c_custkey AS doc_id, CASE c_custkey % 4
        WHEN 0 THEN concat('use 0x', {sha:CAST(c_custkey AS VARCHAR(20))}, '//hard/soft', CAST(c_custkey AS VARCHAR(20)), ' now')
        WHEN 1 THEN concat('0x', {sha:CAST(c_custkey AS VARCHAR(20))}, '/soft///pass', CAST(c_custkey AS VARCHAR(20)))
        WHEN 2 THEN concat('bare 0x', {sha:CAST(c_custkey AS VARCHAR(20))}, ' only')
        ELSE concat('z0x', {sha:CAST(c_custkey AS VARCHAR(20))}, '//hard') END AS text FROM customer""",
}
#: A phrase of 12 words of the syllable list, by the key of a customer.
_K = "((c_custkey * 7919 + {i} * {i} * 131 + {i} * 17) % 2048)"
_W = "substr('bcdfghjklmnpqrst', CAST(floor({k} / 128) AS INT) + 1, 1), substr('aeio', CAST(floor({k} / 32) % 4 AS INT) + 1, 1), substr('bdfgklmn', CAST(floor({k} / 4) % 8 AS INT) + 1, 1), substr('aeio', CAST({k} % 4 AS INT) + 1, 1)"
PHRASE = "concat(" + ", ' ', ".join(_W.replace("{k}", _K.replace("{i}", str(i))) for i in range(12)) + ")"
#: Letters only, so that no number stands in a key by chance.
HEX = "translate({sha:CAST(p_partkey AS VARCHAR(20))}, '0123456789', 'abcdefabcd')"
TABLES = {"planted_props": "part", "planted_mixed": "customer", "planted_uri": "customer", "planted_hex": "orders", "planted_address": "customer", "planted_pii": "customer", "planted_cred": "supplier", "planted_turns": "lineitem", "planted_json": "part", "planted_files": "supplier"}


def _filled(name: str, sha: str) -> str:
    out = RELATIONS[name].replace("{phrase}", PHRASE).replace("{hex}", HEX)
    while "{sha:" in out:
        start = out.index("{sha:")
        end = out.index("}", start)
        out = out[:start] + sha.format(out[start + 5 : end]) + out[end + 1 :]
    return out


def _stellar_sql(source: str, spark: bool) -> str:
    """(doc_id, seed, text): seeds of 32 bytes with version and CRC16, whole, with other last letters, in small letters."""
    xor = (lambda *x: "(" + " ^ ".join(x) + ")") if spark else (lambda x, *more: f"xor({x}, {xor(*more)})" if more else x)
    left = (lambda x, n: f"shiftleft({x}, {n})") if spark else (lambda x, n: f"(({x}) << {n})")
    right = (lambda x, n: f"shiftright({x}, {n})") if spark else (lambda x, n: f"(({x}) >> {n})")
    each = (lambda n, of: f"transform(sequence(0, {n - 1}), i -> {of})") if spark else (lambda n, of: f"[{of} FOR i IN range({n})]")
    glue = (lambda x: f"array_join({x}, '')") if spark else (lambda x: f"array_to_string({x}, '')")
    items = (lambda x: f"array({x})") if spark else (lambda x: f"[{x}]")
    byte = "cast(conv(substr(h, 2 * i + 1, 2), 16, 10) as int)" if spark else "CAST(('0x' || substr(h, CAST(2 * i + 1 AS INT), 2)) AS INT)"
    five = "cast(conv(substr(bits, 5 * i + 1, 5), 2, 10) as int)" if spark else "list_sum([CAST(bits[5 * i + 1 + j] AS INT) * CAST(2 ** (4 - j) AS INT) FOR j IN range(5)])"
    # Spark puts a column that is named once, as in a lambda, into its place, where each element would make it anew
    once = (lambda name, of: f"get(transform(array({name}), {name} -> {of}), 0)") if spark else (lambda name, of: of)
    mixed = xor(right("a", 8), "b")
    y = xor(mixed, right(mixed, 4))
    step = f"({xor(left('a', 8), left(y, 12), left(y, 5), y)} & 65535)"
    crc = f"aggregate(body, 0, (a, b) -> {step})" if spark else f"list_reduce(list_concat([0], body), lambda a, b: {step})"
    many = "concat" if spark else "list_concat"
    bits = "lpad(bin(bytes[i]), 8, '0')" if spark else "lpad(bin(bytes[i + 1]), 8, '0')"
    sha = ("sha2({}, 256)" if spark else "sha256({})").format("CAST(s_suppkey AS VARCHAR(20))")
    return f"""SELECT doc_id, seed, CASE doc_id % 4 WHEN 0 THEN concat('seed ', seed, ' end') WHEN 1 THEN concat('seed ', substr(seed, 1, 54), 'AB end') WHEN 2 THEN concat('seed ', lower(seed)) ELSE 'no seed' END AS text FROM (
        SELECT doc_id, {once("bits", glue(each(56, f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST({five} + 1 AS INT), 1)")))} AS seed FROM (
        SELECT doc_id, {once("bytes", glue(each(35, bits)))} AS bits FROM (
        SELECT doc_id, {many}(body, {items(f"crc & 255, {right('crc', 8)}")}) AS bytes FROM (
        SELECT doc_id, body, {crc} AS crc FROM (
        SELECT doc_id, {once("h", f"{many}({items('144')}, {each(32, byte)})")} AS body FROM (SELECT s_suppkey AS doc_id, {sha} AS h FROM {source}))))))"""


def planted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation's rows, its table's keys dealt over all cores before texts are made of them."""
    source = TABLES.get(name, "supplier")
    rows = table(spark, sf_dir, source)
    # a turn's text is made of its keys, so these are made distinct before it, which also deals them
    rows = rows.select("l_orderkey", "l_linenumber").distinct() if name == "planted_turns" else dealt(rows)
    view = f"{source}_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    try:
        return spark.sql(_stellar_sql(view, True) if name == "planted_stellar" else _filled(name, "sha2({}, 256)").replace("SELECT DISTINCT", "SELECT").replace(f" FROM {source}", f" FROM {view}"))
    finally:
        spark.catalog.dropTempView(view)


def planted_sql(name: str) -> str:
    if name == "planted_stellar":
        return _stellar_sql("supplier", False)
    return _filled(name, "sha256({})")

"""Inspection of texts: detect, merge, decide, mask, audit. Everything stays inside a row, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codecs, crypto
from ..functions.spans import FINDINGS, cut, cut_up, each, let, merge, merge_within_type, no_findings, replace_spans
from ..operators import mnemonics as M
from ..operators import rules as R
from ..operators import structured as S
from . import policy as P

#: What a blocked text becomes, and the message for its sender.
BLOCKED = "[GUARD_BLOCKED: sensitive content removed]"
MESSAGE = "The content holds sensitive information and was blocked."
SCANNERS = ("secret", "address", "credential", "pii", "injection")
#: The column of a text's request, and the type of findings that carry a fingerprint.
CONTEXT = "veil_context"
CONTEXT_TYPE = "struct<source:string,trace_id:string,conversation_id:string,user_id:string,node_type:string,attributes:map<string,string>>"
WITH_FINGERPRINTS = FINDINGS.removesuffix(">>") + ",fingerprint:string>>"
#: Fixed value: the fields of a log line and their order.
LINE = "guard-event direction=%s source=%s entityType=%s riskLevel=%s action=%s ruleId=%s fingerprint=%s spanCount=%s elapsedMs=%s traceId=%s conversationId=%s userId=%s"


def pii_subtype(rule: Column) -> Column:
    named = {"pii-email": "EMAIL", "pii-cn-phone": "PHONE", "pii-cn-id-card": "ID_CARD", "pii-bank-card": "BANK_CARD"}
    out = F.when(rule.startswith("pii-presidio:") & (F.length(F.trim(F.substring(rule, 14, 200))) > 0), F.substring(rule, 14, 200))
    for k, v in named.items():
        out = out.when(rule == k, v)
    return out.otherwise("PII")


def partial_mask(raw: Column) -> Column:
    return F.when(F.length(raw) <= 10, raw).otherwise(F.concat(F.substring(raw, 1, 6), F.lit("..."), F.right(raw, F.lit(4))))


def replacement(entity: Column, rule: Column, raw: Column, key: str) -> Column:
    print8 = crypto.fingerprint(raw, key)
    return (
        F.when(entity.isin(P.IDENTIFIERS), partial_mask(raw))
        .when(entity == "PII", F.concat(F.lit("[PII:"), pii_subtype(rule), F.lit("]")))
        .when(entity == "PROMPT_INJECTION", "[REMOVED_UNTRUSTED_INSTRUCTION]")
        .when(entity.isin(P.SECRETS), F.concat(F.lit("[SECRET:"), entity, F.lit(":"), print8, F.lit("]")))
        .otherwise(F.concat(F.lit("[BLOCKCHAIN_SECRET:"), entity, F.lit(":"), print8, F.lit("]")))
    )


def mask(text: Column, found: Column, key: str) -> Column:
    """The text with every finding replaced; overlapping ones as one."""
    return replace_spans(text, merge(found), lambda x, raw: replacement(x["entity_type"], x["rule_id"], raw, key))


def with_fingerprints(text: Column, found: Column, key: str) -> Column:
    def of(t: Column) -> Column:
        """A span is cut to the text; where nothing is left there is nothing to fingerprint."""
        raw = lambda s, e: F.when(e > s, cut(t["pieces"], s, e))
        return F.transform(found, lambda x: x.withField("fingerprint", crypto.fingerprint(raw(F.greatest(x["start"], F.lit(0)), F.least(x["end"], t["size"])), key)))

    return F.when(F.size(found) > 0, let(cut_up(text), of)).otherwise(F.array().cast(WITH_FINGERPRINTS))


def with_context(df: DataFrame, source: Column | None = None, trace_id: Column | None = None, conversation_id: Column | None = None, user_id: Column | None = None, node_type: Column | None = None, attributes: Column | None = None) -> DataFrame:
    """df with the request that each text belongs to, for its audit events; what isn't given is null, attributes are empty."""
    given = {"source": source, "trace_id": trace_id, "conversation_id": conversation_id, "user_id": user_id, "node_type": node_type}
    parts = [(F.lit(None) if c is None else c).cast("string").alias(name) for name, c in given.items()]
    empty = F.create_map().cast("map<string,string>")
    return df.withColumn(CONTEXT, F.struct(*parts, (empty if attributes is None else F.coalesce(attributes, empty)).alias("attributes")))


def detect(df: DataFrame, text: str = "text", wordlist: DataFrame | None = None, id_col: str = "doc_id", **options) -> DataFrame:
    """Adds `secrets`: findings of the key rules, in the rules' order. wordlist: (lang, word, idx), without which mnemonics aren't sought.

    options: those of `detect_each`.
    """
    return detect_each(df, {"secrets": (text, wordlist)}, **options)


def detect_each(df: DataFrame, texts: dict[str, tuple[str, DataFrame | None]], context_required: bool = False, languages: tuple = ("english",), check_checksum: bool = True, fields: bool = True, skip: tuple = (), own: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Adds findings of the key rules by the name of their column; texts: the column of a text and its word list, or None.

    fields: the string values of a JSON text are searched too, each after its key in words; what is found in them is
    told of the text, beside what is found in it as a whole. skip: ids of rules that leave the plan. own: rules of one's
    own by id, each from a text to an array of findings; they come after the others, in their order. Candidates of all
    texts of a row reach Python in one batch.
    """
    gated, encoded = "_gates" in df.columns, bool(set(R.CODEC_RULES) - set(skip))
    at = list(enumerate(texts.items()))
    alone = {k: F.coalesce(F.col(text), F.lit("")) for k, (_, (text, _)) in at}
    whole = {k: F.col(f"_whole{k}") for k in alone}
    if fields:
        df = df.withColumns({f"_whole{k}": S.with_fields(t) for k, t in alone.items()})
    t = {k: whole[k]["text"] if fields else alone[k] for k in alone}
    if not gated:
        df = df.withColumns({f"_gates{k}": R.key_gates(t[k], "cardano-signing-key" not in skip) for k in t})
    gates = {k: F.col("_gates") if gated else F.col(f"_gates{k}") for k in t}
    if encoded:
        df = df.withColumns({f"_candidates{k}": R.codec_candidates(t[k], gates[k]["key"]) for k in t})
        df = df.withColumns({f"_verdicts{k}": codecs.verified(F.transform(f"_candidates{k}", lambda c: F.struct(c["rule"].alias("rule"), c["value"].alias("value")))) for k in t})
    for k, (column, (_, wordlist)) in at:
        found = _findings(t[k], alone[k], gates[k], (F.col(f"_candidates{k}"), F.col(f"_verdicts{k}")), wordlist, context_required, languages, check_checksum, skip, own)
        df = df.withColumn(column, (S.placed_back(found.cast(FINDINGS), whole[k]) if fields else found).cast(FINDINGS))
    return df.drop(*(f"_{name}{k}" for name in ("whole", "gates", "candidates", "verdicts") for k in t))


def _findings(t: Column, alone: Column, gates: Column, checked: tuple[Column, Column], wordlist: DataFrame | None, context_required: bool, languages: tuple, check_checksum: bool, skip: tuple, own: dict[str, Callable[[Column], Column]] | None) -> Column:
    """Findings in a text t, or, where a rule is of texts as a whole, in the text without its fields. checked: candidates, verdicts."""
    key = gates["key"]
    codec = lambda rule: F.when(F.size(checked[0]) > 0, R.codec_matches(*checked, rule)).otherwise(no_findings())
    tables = [] if wordlist is None else M.word_tables(wordlist, languages)
    uris = lambda: F.concat(R.substrate_uri(t, key), *(M.phrase_uris(t, table) for table in tables))
    rules = {
        "bip39-mnemonic": lambda: M.mnemonic_findings(t, tables, check_checksum) if tables else no_findings(),
        "evm-privkey-hex": lambda: R.evm_private_key(t, context_required, key), "bitcoin-wif": lambda: codec("bitcoin-wif"), "extended-key": lambda: codec("extended-key"), "solana-keypair": lambda: R.solana_keypair(t),
        "sui-privkey": lambda: codec("sui-privkey"), "substrate-secret-uri": uris, "cardano-signing-key": lambda: R.cardano_signing_key(alone, gates["signing"]),
        "stellar-seed": lambda: codec("stellar-seed"), "keystore-json": lambda: R.keystore_json(alone), "pem-private-key": lambda: R.pem_private_key(t),
    }
    if unknown := set(skip) - set(rules):
        raise ValueError(f"no such rules: {sorted(unknown)}")
    made = {rule: make() for rule, make in rules.items() if rule not in skip}
    words = made.pop("bip39-mnemonic", no_findings())
    # a text without a long run or any of these signs has nothing for the other rules, of which none is tried
    signs = {"solana-keypair": "[", "keystore-json": '"', "pem-private-key": "PRIVATE KEY"} | ({"substrate-secret-uri": "/"} if tables else {})
    some = key | gates["signing"]
    for rule, sign in signs.items():
        some = some | F.contains(t, F.lit(sign)) if rule in made else some
    rest = F.when(some, F.concat(no_findings(), *made.values())).otherwise(no_findings())
    return F.concat(words, rest, *(rule(t).cast(FINDINGS) for rule in (own or {}).values()))


def scan(df: DataFrame, text: str = "text", scanners: tuple = SCANNERS, extra: list[Column] | None = None, entropy: float = R.MIN_ENTROPY) -> DataFrame:
    """Adds `found`: findings of all scanners, in their order. Needs `secrets`. A scanner that isn't listed leaves the plan."""
    t = F.coalesce(F.col(text), F.lit(""))
    gated = "_gates" in df.columns
    df = df if gated else df.withColumn("_gates", R.gates(t))
    gate = F.col("_gates")
    made = {"secret": lambda: F.col("secrets"), "address": lambda: R.addresses(t, gate["run"]), "credential": lambda: R.credentials(t, gate["named"], gate["password"], entropy), "pii": lambda: R.pii(t, gate["digits"]), "injection": lambda: R.prompt_injection(t)}
    parts = [made[s]() for s in SCANNERS if s in scanners] + list(extra or [])
    df = df.withColumn("found", F.concat(*parts).cast(FINDINGS) if parts else no_findings())
    return df if gated else df.drop("_gates")


def inspect(df: DataFrame, id_col: str = "doc_id", text: str = "text", direction: str | Column = "USER_INPUT", scanners: tuple = SCANNERS, policy: DataFrame | None = None, fallback: str = P.FALLBACK, pepper: str | None = None, wordlist: DataFrame | None = None, extra: list[Column] | None = None, max_chars: int = 0, keys: bool = True, entropy: float = R.MIN_ENTROPY, **rules) -> DataFrame:
    """df with action, sanitized_text, findings (with fingerprints), user_message and blocked.

    A null or empty text is allowed as it is. A text with a certain private key is blocked at once: its findings are
    those of the key rules, merged across types. Any other text is scanned by all scanners; findings are merged
    within their type and decide the action together, and a masked text has all of them masked. Whole texts are
    searched; with max_chars, a limit to opt into, only their first characters. keys: whether key rules run at all.
    rules: options of `detect`.
    """
    key = pepper or crypto.pepper()
    where = direction if isinstance(direction, Column) else F.lit(direction)
    t = F.coalesce(F.col(text), F.lit(""))
    # what a text holds at all is found once, for all rules
    seen = text
    if max_chars > 0:
        seen, df = "_seen", df.withColumn("_seen", F.substring(t, 1, max_chars))
    df = df.withColumns({"_direction": where, "_gates": R.gates(F.coalesce(F.col(seen), F.lit("")))})
    df = detect(df, seen, wordlist, id_col, **rules) if keys else df.withColumn("secrets", no_findings())
    df = scan(df, seen, scanners, extra, entropy)
    df = df.withColumn("_critical", F.exists("secrets", lambda x: x["risk_level"] == "CRITICAL"))
    df = df.withColumn("_merged", F.when(F.col("_critical"), merge(F.col("secrets"))).otherwise(merge_within_type(F.col("found"))))
    act = P.decider(policy, fallback)
    df = df.withColumn("action", F.when(F.col("_critical"), "BLOCK").otherwise(P.strictest(F.transform("_merged", lambda x: act(x["entity_type"], F.col("_direction"), x["risk_level"])))))
    sanitized = F.when(F.col("action") == "BLOCK", BLOCKED).when(F.col("action") == "ALLOW", F.col(text)).otherwise(mask(t, F.col("_merged"), key))
    df = df.withColumns({"sanitized_text": sanitized, "findings": with_fingerprints(t, F.col("_merged"), key), "user_message": F.when(F.col("action") == "BLOCK", MESSAGE), "blocked": F.col("action") == "BLOCK", "direction": F.col("_direction")})
    return df.drop("secrets", "found", "_critical", "_merged", "_direction", "_gates", "_seen")


def audit_events(decisions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One event for each finding of a decision; it never holds the text. Every event carries the decision's action.

    The request's fields are those of `with_context`, else null. elapsed_ms is null: rows of a plan have no time of
    their own. metadata_json is null too, a place for what a sink adds.
    """
    context = F.col(CONTEXT) if CONTEXT in decisions.columns else F.lit(None).cast(CONTEXT_TYPE)
    rows = each(decisions, "findings", F.col(id_col).alias("doc_id"), "direction", "action", context.alias("c"), F.size("findings").cast("long").alias("span_count"), place="seq")
    return rows.select(
        "doc_id", "seq", "direction", "c.source", "f.entity_type", "f.risk_level", "f.confidence", "action", "f.rule_id", "f.fingerprint", "span_count", F.lit(None).cast("long").alias("elapsed_ms"),
        "c.trace_id", "c.conversation_id", "c.user_id", F.lit(None).cast("string").alias("metadata_json"), (F.col("f.end") - F.col("f.start")).alias("span_length"),
    )


def audit_lines(events: DataFrame) -> DataFrame:
    """Events as log lines; what is null reads null."""
    said = ["direction", "source", "entity_type", "risk_level", "action", "rule_id", "fingerprint", "span_count", "elapsed_ms", "trace_id", "conversation_id", "user_id"]
    return events.select("doc_id", "seq", F.format_string(LINE, *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in said)).alias("line"))

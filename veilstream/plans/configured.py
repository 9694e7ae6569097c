"""Inspection, audit and conversations as settings say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crypto
from ..operators import conversations
from ..sources import providers
from ..sources.settings import Settings
from . import inspection


def scanners(settings: Settings) -> tuple[str, ...]:
    off = {"secret": not settings.secret_enabled, "credential": not settings.secret_enabled, "pii": not settings.pii_enabled, "injection": not settings.injection_enabled}
    return tuple(s for s in inspection.SCANNERS if not off.get(s))


def provider_findings(settings: Settings, text: Column) -> list[Column]:
    """Findings of the remote services that are switched on; none is called otherwise."""
    out, lang = [], providers.language(text, settings.pii_language)
    if settings.pii_enabled and settings.pii_provider_enabled:
        endpoint, seconds = settings.pii_endpoint, settings.pii_timeout_ms / 1000
        call = providers.entities_udf(lambda: providers.pii_client(endpoint, seconds), seconds, settings.pii_breaker_calls if settings.pii_breaker else 0, settings.pii_breaker_cooldown_ms / 1000)
        out.append(providers.pii_findings(text, call(text, lang), settings.pii_min_score, list(settings.pii_allowed_types)))
    if settings.injection_enabled and settings.injection_provider_enabled:
        address, limit = settings.injection_endpoint, settings.injection_timeout_ms / 1000
        call = providers.entities_udf(lambda: providers.injection_client(address, limit), limit, settings.injection_breaker_calls if settings.injection_breaker else 0, settings.injection_breaker_cooldown_ms / 1000)
        out.append(providers.injection_findings(text, call(text, lang), settings.injection_min_score))
    return out


def inspect(df: DataFrame, settings: Settings, text: str = "text", wordlist: DataFrame | None = None, pepper: str | None = None, **options) -> DataFrame:
    """inspection.inspect with the settings' scanners and thresholds; switched off, every text is allowed as it is."""
    if not settings.enabled:
        where = options.get("direction", "USER_INPUT")
        return df.withColumns({
            "action": F.lit("ALLOW"), "sanitized_text": F.col(text), "findings": F.array().cast(inspection.WITH_FINGERPRINTS), "user_message": F.lit(None).cast("string"),
            "blocked": F.lit(False), "direction": where if isinstance(where, Column) else F.lit(where),
        })
    return inspection.inspect(
        df, text=text, scanners=scanners(settings), wordlist=wordlist if settings.secret_enabled else None, pepper=pepper or crypto.pepper(settings.audit_pepper_variable),
        extra=provider_findings(settings, F.coalesce(F.col(text), F.lit(""))), max_chars=settings.max_chars, keys=settings.secret_enabled, languages=settings.secret_languages,
        check_checksum=settings.secret_checksum, context_required=settings.secret_hex_context_required, entropy=settings.secret_min_entropy, **options,
    )


def audit_events(decisions: DataFrame, settings: Settings, id_col: str = "doc_id") -> DataFrame:
    """Events of the decisions; none with the audit switched off."""
    events = inspection.audit_events(decisions, id_col)
    return events if settings.audit_enabled else events.where(F.lit(False))


def cross_turn(turns: DataFrame, settings: Settings, conv: str = "conv_id", turn: str = "turn", wordlist: DataFrame | None = None, **options) -> DataFrame:
    """conversations.cross_turn with the settings' windows; switched off, no turn is blocked."""
    if not (settings.enabled and settings.window_enabled):
        return turns.select(conv, turn, F.lit(False).alias("blocked"), F.array().cast("array<string>").alias("critical_entities"))
    return conversations.cross_turn(turns, conv, turn, wordlist, n=settings.window_turns, ttl=settings.window_ttl_seconds, **options)


def found_types(found: Column) -> Column:
    """The distinct entity types of findings."""
    return F.array_distinct(F.transform(found, lambda x: x["entity_type"]))


def holds(found: Column, expected: Column) -> Column:
    """Whether all expected types were found; with none expected, whether nothing was."""
    return F.when(F.size(expected) == 0, F.size(found) == 0).otherwise(F.size(F.array_except(expected, found)) == 0)

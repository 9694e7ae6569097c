"""Settings of an inspection, from the session's configuration, a JSON file or a mapping.

A setting `window_turns` is `spark.veil.window_turns` in the session, and {"window": {"turns": 3}} or
{"window_turns": 3} in a file. What isn't given has its default; a name that doesn't exist or a value of the wrong
kind is an error.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from ..operators.rules import MIN_ENTROPY
from .providers import ALLOWED_TYPES

PREFIX = "spark.veil."


@dataclass(frozen=True)
class Settings:
    enabled: bool = True
    #: Characters of a text that are searched; 0: all of them.
    max_chars: int = 0
    secret_enabled: bool = True
    secret_languages: tuple[str, ...] = ("english",)
    secret_checksum: bool = True
    secret_hex_context_required: bool = True
    secret_min_entropy: float = MIN_ENTROPY
    window_enabled: bool = True
    window_turns: int = 3
    window_ttl_seconds: int = 1800
    pii_enabled: bool = True
    pii_provider_enabled: bool = False
    pii_endpoint: str = "http://localhost:5002"
    pii_timeout_ms: int = 300
    pii_language: str = "en"
    pii_min_score: float = 0.5
    pii_allowed_types: tuple[str, ...] = tuple(ALLOWED_TYPES)
    pii_breaker: bool = True
    pii_breaker_calls: int = 3
    pii_breaker_cooldown_ms: int = 30_000
    injection_enabled: bool = False
    injection_provider_enabled: bool = False
    injection_endpoint: str = "http://localhost:8000"
    injection_timeout_ms: int = 500
    injection_min_score: float = 0.5
    injection_breaker: bool = True
    injection_breaker_calls: int = 3
    injection_breaker_cooldown_ms: int = 30_000
    audit_enabled: bool = True
    audit_pepper_variable: str = "VEIL_PEPPER"


def _parsed(name: str, value, default):
    """A value as its default's kind; texts are read as in a configuration file."""
    try:
        if isinstance(default, bool):
            return {"true": True, "false": False}[str(value).strip().lower()]
        if isinstance(default, tuple):
            items = value.split(",") if isinstance(value, str) else value
            return tuple(s for s in (str(x).strip() for x in items) if s)
        return type(default)(value)
    except (KeyError, TypeError, ValueError):
        raise ValueError(f"{name} can't be {value!r}") from None


def from_mapping(values: Mapping) -> Settings:
    """Settings by name; nested mappings stand for names joined by underscores."""
    defaults = {f.name: f.default for f in fields(Settings)}
    flat: dict = {}

    def flatten(part: Mapping, before: str) -> None:
        for key, value in part.items():
            name = before + str(key).replace("-", "_")
            if isinstance(value, Mapping):
                flatten(value, name + "_")
            else:
                flat[name] = value

    flatten(values, "")
    if unknown := sorted(set(flat) - set(defaults)):
        raise ValueError(f"no such settings: {', '.join(unknown)}")
    return Settings(**{name: _parsed(name, value, defaults[name]) for name, value in flat.items()})


def from_session(spark: SparkSession) -> Settings:
    given = {f.name: spark.conf.get(PREFIX + f.name, None) for f in fields(Settings)}
    return from_mapping({name: value for name, value in given.items() if value is not None})


def from_file(spark: SparkSession, path: str) -> Settings:
    """Settings of one JSON file, read by Spark, so it may lie in any store."""
    return from_mapping(json.loads(spark.read.option("wholetext", True).text(path).first()["value"]))

"""Redaction policies: what to look for and what to put in its place, from JSON, YAML or plain dicts.

Unknown fields are dropped. Blocks that the format knows but nothing acts on
(currency, phone number extension, street address, policy-level ignore lists,
crypto, valid-date and valid-domain switches, ignore files, model time-outs,
window sizes and priorities) parse and have no effect.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_FORMAT = "{{{REDACTED-%t}}}"


class PolicyError(ValueError):
    """A policy that can't be read or compiled."""


@dataclass(frozen=True)
class Strategy:
    kind: str = ""
    format: str = ""
    static: str = ""
    mask: str = ""
    days: int = 0
    months: int = 0
    years: int = 0


@dataclass(frozen=True)
class IgnoredPattern:
    pattern: str
    name: str = ""
    case_sensitive: bool = False


@dataclass(frozen=True)
class Block:
    """What all detectors can be told, and in ``options`` what only some of them can."""

    key: str
    enabled: bool = True
    ignored: tuple[str, ...] = ()
    ignored_patterns: tuple[IgnoredPattern, ...] = ()
    strategies: tuple[Strategy, ...] = ()
    options: Mapping[str, Any] = field(default_factory=dict)

    @property
    def strategy(self) -> Strategy | None:
        """Only the first strategy ever counts."""
        return self.strategies[0] if self.strategies else None


@dataclass(frozen=True)
class Policy:
    blocks: Mapping[str, Block] = field(default_factory=dict)
    models: tuple[Block, ...] = ()
    dictionaries: tuple[Block, ...] = ()


# The single blocks of a policy, and their options with types.
SINGLE = (
    "age", "bankRoutingNumber", "bitcoinAddress", "creditCard", "currency", "date", "driversLicense",
    "emailAddress", "ibanCode", "ipAddress", "macAddress", "passportNumber", "phoneNumber", "phoneNumberExtension",
    "ssn", "streetAddress", "trackingNumber", "url", "vin", "zipCode",
)
OPTIONS: dict[str, dict[str, type]] = {
    "creditCard": {"onlyValidCreditCardNumbers": bool},
    "date": {"onlyValidDates": bool},
    "emailAddress": {"onlyValidTLDs": bool},
    "url": {"requireHttpWwwPrefix": bool},
    "zipCode": {"requireDelimiter": bool},
    "dictionaries": {"terms": list, "files": list, "caseSensitive": bool, "fuzzy": str},
    "pheye": {"removePunctuation": bool, "bearerToken": str, "windowSize": int, "priority": int, "pheyeConfiguration": dict},
}
# The fields of a strategy.
STRATEGY_FIELDS = {
    "strategy": ("kind", str),
    "redactionFormat": ("format", str),
    "staticReplacement": ("static", str),
    "maskCharacter": ("mask", str),
    "shiftDays": ("days", int),
    "shiftMonths": ("months", int),
    "shiftYears": ("years", int),
}


def strategies_field(key: str) -> str:
    return {"dictionaries": "dictionaryFilterStrategies"}.get(key, f"{key}FilterStrategies")


def _typed(value: Any, kind: type, where: str) -> Any:
    ok = isinstance(value, kind) and not (kind is int and isinstance(value, bool))
    if not ok:
        raise PolicyError(f"{where}: expected {kind.__name__}, found {type(value).__name__}")
    return value


def _object(value: Any, where: str) -> dict:
    return _typed(value, dict, where)


def _given(raw: dict, name: str, kind: type, where: str) -> Any:
    """A field, or the empty value of its type where it is missing or null."""
    value = raw.get(name)
    return kind() if value is None else _typed(value, kind, f"{where}.{name}")


def _strings(value: Any, where: str) -> tuple[str, ...]:
    return tuple(_typed(x, str, where) for x in _typed(value, list, where)) if value is not None else ()


def _strategy(raw: Any, where: str) -> Strategy:
    found = {}
    for name, (attr, kind) in STRATEGY_FIELDS.items():
        if (v := _object(raw, where).get(name)) is not None:
            found[attr] = _typed(v, kind, f"{where}.{name}")
    return Strategy(**found)


def _block(key: str, raw: Any) -> Block:
    raw = _object(raw, key)
    enabled = raw.get("enabled")
    patterns = []
    for p in _given(raw, "ignoredPatterns", list, key):
        p = _object(p, f"{key}.ignoredPatterns")
        patterns.append(
            IgnoredPattern(
                _given(p, "pattern", str, key),
                _given(p, "name", str, key),
                _given(p, "caseSensitive", bool, key),
            )
        )
    options = {}
    for name, kind in OPTIONS.get(key, {}).items():
        if (v := raw.get(name)) is not None:
            options[name] = list(_strings(v, f"{key}.{name}")) if kind is list else _typed(v, kind, f"{key}.{name}")
    return Block(
        key,
        True if enabled is None else _typed(enabled, bool, f"{key}.enabled"),
        _strings(raw.get("ignored"), f"{key}.ignored"),
        tuple(patterns),
        tuple(_strategy(s, f"{key} strategy") for s in _given(raw, strategies_field(key), list, key)),
        options,
    )


def parse_policy(source: str | Mapping | Policy) -> Policy:
    """A policy from JSON text or a dict."""
    if isinstance(source, Policy):
        return source
    if isinstance(source, str):
        try:
            source = json.loads(source)
        except ValueError as e:
            raise PolicyError(f"no valid JSON: {e}") from e
    ids = _given(_object(source, "policy"), "identifiers", dict, "policy")
    several = lambda key: tuple(_block(key, x) for x in _given(ids, key, list, "identifiers"))
    return Policy({k: _block(k, ids[k]) for k in SINGLE if ids.get(k) is not None}, several("pheye"), several("dictionaries"))


def parse_policy_yaml(source: str) -> Policy:
    try:
        import yaml
    except ImportError as e:
        raise PolicyError("reading YAML needs the yaml package") from e
    try:
        raw = yaml.safe_load(source)
    except yaml.YAMLError as e:
        raise PolicyError(f"no valid YAML: {e}") from e
    return parse_policy(raw if raw is not None else {})


def is_valid_json(source: str) -> bool:
    try:
        parse_policy(source)
    except PolicyError:
        return False
    return True


def is_valid_yaml(source: str) -> bool:
    try:
        parse_policy_yaml(source)
    except PolicyError:
        return False
    return True


def valid_policies(source: str | Column, yaml: bool = False) -> Column:
    """is_valid_json() or is_valid_yaml() of a column; null is not valid. Policies that recur are parsed once a batch."""
    test = is_valid_yaml if yaml else is_valid_json

    @F.pandas_udf("boolean")
    def valid(texts: pd.Series) -> pd.Series:
        known = {t: test(t) for t in texts.dropna().unique()}
        return texts.map(known).fillna(False).astype(bool)

    return valid(source)

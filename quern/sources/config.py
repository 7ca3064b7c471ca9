"""Typed configuration: JSON file, .env file and environment, validated (SRC-30, SUP-10, SUP-23, SUP-24)."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

PREFIX = "QUERN_"


@dataclass(frozen=True)
class SourceConfig:
    name: str
    kind: str
    path: str
    enabled: bool = True
    required: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    min_price: int | None = None
    max_price: int | None = None
    api_key: str = ""


@dataclass(frozen=True)
class Config:
    poll_seconds: int = 3600
    max_notifications: int = 12
    reserved_reviews: int = 2
    max_age_hours: float = 6.0
    daily_budget_usd: float = 5.0
    hot_profit: int = 4000
    hot_roi: int = 20
    severity: dict[str, int] = field(default_factory=lambda: {"none": 0, "info": 0, "low": 5, "medium": 15, "high": 40, "blocking": 40})
    enabled_statuses: tuple[str, ...] = ("HOT", "INTERESTING", "MANUAL_REVIEW")
    sources: tuple[SourceConfig, ...] = ()

    def usable_sources(self) -> tuple[SourceConfig, ...]:
        """Enabled sources; one that needs a key and has none is left out, the others stay."""
        return tuple(s for s in self.sources if s.enabled and (s.kind != "api" or s.api_key))


def read_env(path: str | Path) -> dict[str, str]:
    """KEY=value lines; blank lines and comments skipped, quotes dropped; a missing file is empty."""
    out: dict[str, str] = {}
    if Path(path).exists():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            line = line.strip()
            if line and not line.startswith("#") and "=" in line:
                key, value = line.split("=", 1)
                out[key.strip()] = value.strip().strip("\"'")
    return out


def _build(kind: type, data: dict[str, Any]):
    """Unknown keys are dropped and missing ones take defaults; lists become tuples."""
    names = {f.name for f in fields(kind)}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items() if k in names})


def validate(c: Config) -> list[str]:
    """Every broken rule in words; empty if the configuration holds."""
    rules = [
        (60 <= c.poll_seconds <= 86_400, "poll_seconds must be from 60 to 86400"),
        (1 <= c.max_notifications <= 100, "max_notifications must be from 1 to 100"),
        (0 <= c.reserved_reviews <= c.max_notifications, "reserved_reviews must not exceed max_notifications"),
        (c.daily_budget_usd >= 0, "daily_budget_usd must not be negative"),
        (c.hot_profit > 0 and 0 < c.hot_roi <= 1000, "hot thresholds must be positive"),
        (set(c.enabled_statuses) <= {"HOT", "INTERESTING", "MANUAL_REVIEW", "LOW_PRIORITY", "REJECT"}, "enabled_statuses holds an unknown status"),
        (c.severity.get("low", 0) <= c.severity.get("medium", 0) <= c.severity.get("high", 0), "severities must not fall"),
        (len({s.name for s in c.sources}) == len(c.sources), "source names must differ"),
    ]
    rules += [(s.min_price is None or s.max_price is None or s.min_price <= s.max_price, f"{s.name}: min_price is above max_price") for s in c.sources]
    return [why for ok, why in rules if not ok]


def load(path: str | Path, env: dict[str, str] | None = None) -> Config:
    """Configuration of a JSON file, overlaid by QUERN_<FIELD> of the .env beside it and then of ``env`` (the process by default).

    A source's key comes from QUERN_<NAME>_API_KEY; an invalid configuration raises.
    """
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    env = read_env(Path(path).with_name(".env")) | (dict(os.environ) if env is None else env)
    key = lambda s: env.get(f"{PREFIX}{str(s.get('name', '')).upper()}_API_KEY", s.get("api_key", ""))
    data["sources"] = [_build(SourceConfig, s | {"api_key": key(s)}) for s in data.get("sources", [])]
    config = _build(Config, data)
    for f in fields(Config):
        raw = env.get(PREFIX + f.name.upper())
        now = getattr(config, f.name)
        if raw is not None and isinstance(now, (int, float, str)):
            config = replace(config, **{f.name: type(now)(raw)})
    if broken := validate(config):
        raise ValueError("; ".join(broken))
    return config

"""Settings with their defaults and checks."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    min_query_len: int = 2  # bytes
    max_query_latency_ms: int = 200
    default_limit: int = 10
    max_limit: int = 100
    word_cap: int = 100_000
    promotion_threshold: int = 20
    promotion_window_s: int = 60
    promotion_max_words: int = 50_000
    promotion_queue: int = 256
    ledger_idle_ttl_s: int = 600
    index_stride: int = 4096
    usage_enabled: bool = True
    usage_depth: int = 3
    usage_track_surfaced: bool = True
    versions_kept: int = 3
    prune_max_hits: int = 0
    migrate_usage: bool = True

    def __post_init__(self):
        object.__setattr__(self, "min_query_len", max(1, self.min_query_len))
        if self.word_cap < self.promotion_max_words:
            raise ValueError("word_cap must not be below promotion_max_words")
        if not 1 <= self.usage_depth <= 8:
            raise ValueError("usage_depth must be from 1 to 8")
        if self.versions_kept < 1:
            raise ValueError("versions_kept must be 1 at least")
        if self.max_query_latency_ms < 10:
            raise ValueError("max_query_latency_ms must be 10 at least")

    @classmethod
    def from_env(cls, env=None, prefix: str = "LEXIDUCT_") -> Settings:
        """Reads LEXIDUCT_<NAME>; what is absent, empty or unreadable keeps its default."""
        env = os.environ if env is None else env
        got = {}
        for f in fields(cls):
            raw = (env.get(prefix + f.name.upper()) or "").strip()
            if not raw:
                continue
            if isinstance(f.default, bool):
                if raw.lower() in ("1", "true", "yes", "on", "0", "false", "no", "off"):
                    got[f.name] = raw.lower() in ("1", "true", "yes", "on")
            elif raw.lstrip("-").isdigit():
                got[f.name] = int(raw)
        return cls(**got)

"""Run-time settings (CFG-04): defaults, then the environment, then arguments."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

TRUE = ("1", "true", "yes", "on")


def env_flag(env: Mapping[str, str], name: str, default: bool = False) -> bool:
    value = env.get(name)
    return default if value is None or not value.strip() else value.strip().lower() in TRUE


def env_int(env: Mapping[str, str], name: str, default: int) -> int:
    """A positive whole number, else the default."""
    value = (env.get(name) or "").strip()
    return int(value) if value.isdigit() and int(value) > 0 else default


@dataclass
class Provider:
    name: str
    model: str = ""
    concurrency: int = 5
    timeout_ms: int = 90_000


@dataclass
class Config:
    source_language: str = "English"
    target_language: str = "Chinese (Simplified)"
    providers: dict[str, Provider] = field(default_factory=dict)

    @classmethod
    def create(cls, names: tuple[str, ...], env: Mapping[str, str] | None = None, concurrency: int | None = None, **languages: str) -> Config:
        """A provider's own variable goes before the common one; an argument before both."""
        env = os.environ if env is None else env
        found = {}
        for name in names:
            upper = name.upper()
            count = concurrency or env_int(env, f"{upper}_CONCURRENCY", env_int(env, "CONCURRENCY", 5))
            found[name] = Provider(name, env.get(f"{upper}_MODEL", env.get("MODEL", "")), count, env_int(env, f"{upper}_TIMEOUT_MS", env_int(env, "TIMEOUT_MS", 90_000)))
        return cls(providers=found, **languages)

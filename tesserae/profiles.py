"""What an engine of each profile can do."""

from __future__ import annotations

from .errors import EngineError

#: Capabilities by profile.
PROFILES = {
    "core": {"crud", "query"},
    "docs": {"crud", "query", "sql", "joins", "backup", "exchange"},
    "ai": {"crud", "query", "sql", "joins", "backup", "exchange", "vectors", "agents"},
}


def require(profile: str, capability: str) -> None:
    if profile not in PROFILES:
        raise EngineError(f"unknown profile {profile}")
    if capability not in PROFILES[profile]:
        raise EngineError(f"the profile {profile} has no {capability}")

"""Decisions of an indexing run: what runs, what falls back, what is reused."""

from __future__ import annotations

from dataclasses import dataclass, field

# Why a plugin failed.
UNAVAILABLE = ("provider-unavailable", "version-mismatch", "dependency-missing")
NEVER = ("cancelled", "source-changed")


def may_fall_back(policy: str, failure: str) -> bool:
    """None: never; OnUnavailable: if the plugin could not start; OnFailure: unless cancelled or the sources changed."""
    if policy == "None":
        return False
    if policy == "OnUnavailable":
        return failure in UNAVAILABLE
    if policy == "OnFailure":
        return failure not in NEVER
    raise ValueError(policy)


def is_noop(counts: dict[str, int]) -> bool:
    """Whether nothing changed, so that the previous publication is returned and no run begins."""
    return not (counts.get("new", 0) or counts.get("changed", 0) or counts.get("deleted", 0))


@dataclass
class Outcome:
    """What happened: which plugin indexed each path, who failed for good, which capabilities were lost."""

    owner: dict[str, str] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)
    lost: int = 0


def takeovers(owned: dict[str, list[str]], failures: dict[str, str], policies: dict[str, str], order: list[str], capabilities: dict[str, int], claims: dict[str, set[str]]) -> Outcome:
    """After the first phase: paths of failed plugins go to the next plugin in order that claims them.

    Each plugin runs once at most; what a failed one can do and its successor cannot is lost.
    owned: plugin -> paths, claims: plugin -> paths it could take.
    """
    out = Outcome({p: plugin for plugin, paths in owned.items() if plugin not in failures for p in paths})
    for plugin in order:
        if plugin not in failures:
            continue
        rest = order[order.index(plugin) + 1 :]
        runner = next((r for r in rest if r not in failures and set(owned[plugin]) <= claims.get(r, set())), None) if may_fall_back(policies.get(plugin, "None"), failures[plugin]) else None
        if runner is None:
            out.failed[plugin] = failures[plugin]
            continue
        out.owner |= dict.fromkeys(owned[plugin], runner)
        out.lost |= capabilities.get(plugin, 0) & ~capabilities.get(runner, 0)
    return out

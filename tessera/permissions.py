"""Which permissions a definition needs, and which it claims."""

from __future__ import annotations

from .plans import nodes as n

_claimed: set[str] = set()

#: What output of event rows needs.
EVENT_LEVEL = "event_level_data"


class PermissionsError(Exception):
    """A definition that reads tables or makes outputs for which it has no permission."""


def claim_permissions(*names: str) -> None:
    """States that the project has these permissions; counts where nothing is enforced."""
    for name in names:
        if not isinstance(name, str):
            raise TypeError("permissions are strings")
    _claimed.update(names)


def claimed() -> set[str]:
    return set(_claimed)


def required(*roots: n.Node, event_tables: bool = False) -> dict[str, list[str]]:
    """Needed permissions, each with the tables that need it."""
    out: dict[str, list[str]] = {}
    for x in n.walk(*roots):
        if isinstance(x, n.Table) and x.required_permission and x.name not in out.setdefault(x.required_permission, []):
            out[x.required_permission].append(x.name)
    if event_tables:
        out.setdefault(EVENT_LEVEL, []).append("event tables")
    return out


def enforce(needed: dict[str, list[str]], granted: set[str]) -> None:
    missing = {k: v for k, v in needed.items() if k not in granted}
    if missing:
        raise PermissionsError("missing permissions: " + "; ".join(f"{k} for {', '.join(v)}" for k, v in sorted(missing.items())))

"""Row-level security: permissive policies are ORed, restrictive ones ANDed; no policy allows all."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.predicates import all_of, any_of

OPERATIONS = ("select", "insert", "update", "delete")


@dataclass(frozen=True)
class Policy:
    """``allows(user)`` is a condition on rows; ``operations`` those that it speaks about."""

    name: str
    allows: Callable[[dict], Column]
    restrictive: bool = False
    operations: tuple[str, ...] = OPERATIONS


@dataclass
class Policies:
    rules: list[Policy] = field(default_factory=list)
    enabled: bool = True

    def add(self, *rules: Policy) -> Policies:
        self.rules += rules
        return self

    def condition(self, operation: str, user: dict) -> Column | None:
        """None where every row is allowed."""
        rules = [r for r in self.rules if operation in r.operations] if self.enabled else []
        if not rules:
            return None
        permissive = [r.allows(user) for r in rules if not r.restrictive]
        restrictive = [r.allows(user) for r in rules if r.restrictive]
        parts = ([any_of(*permissive)] if permissive else []) + restrictive
        return all_of(*parts)


def _admin(user: dict) -> bool:
    return "admin" in user.get("roles", ())


def owner(field_: str = "userId") -> Policy:
    return Policy("owner", lambda u: F.lit(True) if _admin(u) else F.col(field_) == F.lit(u.get("id")))


def team(field_: str = "teamId") -> Policy:
    return Policy("team", lambda u: F.lit(True) if _admin(u) else F.col(field_).isin(*u["teams"]) if u.get("teams") else F.lit(False))


def role(name: str) -> Policy:
    return Policy(f"role {name}", lambda u: F.lit(_admin(u) or name in u.get("roles", ())))


def admin_all() -> Policy:
    return Policy("admin", lambda u: F.lit(_admin(u)))


def viewer_read_only() -> Policy:
    """Viewers change nothing."""
    return Policy("viewer read only", lambda u: F.lit("viewer" not in u.get("roles", ())), True, ("insert", "update", "delete"))


def viewer_select() -> Policy:
    return Policy("viewer select", lambda u: F.lit("viewer" in u.get("roles", ())), False, ("select",))


def public_read() -> Policy:
    return Policy("public read", lambda _: F.lit(True), False, ("select",))


def authenticated_only() -> Policy:
    return Policy("authenticated", lambda u: F.lit(u.get("id") is not None), True)


PRESETS: dict[str, Callable[[], list[Policy]]] = {
    "admin_and_owner": lambda: [admin_all(), owner()],
    "admin_and_team": lambda: [admin_all(), team()],
    "viewer_read_only": lambda: [viewer_select(), viewer_read_only()],
    "public_read": lambda: [public_read()],
    "authenticated": lambda: [public_read(), authenticated_only()],
}

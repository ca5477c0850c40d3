"""All registered queries."""

from arenaflow.plans import backoffice, boards, cards, encounters, identities, leaderboards, relational, serving, telemetry, upkeep  # noqa: F401
from arenaflow.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

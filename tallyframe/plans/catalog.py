"""All registered queries."""

from __future__ import annotations

from tallyframe.plans import composites, evidence, round_trips  # noqa: F401  they register their queries
from tallyframe.plans.reports import REGISTRY

__all__ = ["REGISTRY"]

"""Registered queries: name, Spark callable and the SQL that checks it."""

from martspark.registry.base import ORACLES, QUERIES
from martspark.registry import (  # noqa: F401  (importing a module registers its queries)
    analytics,
    checks,
    feed,
    forecasting,
    layers,
    storage,
    streams,
    vectors,
)
from martspark.registry import invariants  # noqa: F401, E402  (after the entries that it checks)

__all__ = ["ORACLES", "QUERIES"]

"""Registered queries over the driver tables, each with its SQL where SQL can say it."""

from tidewatch.catalog.registry import REGISTRY
from tidewatch.catalog import (  # noqa: F401  (importing registers the queries)
    sources_, shaping_, joins_, aggregates_, windows_, scalars_, models_, views_, streams_, checks_,
)

__all__ = ["REGISTRY"]

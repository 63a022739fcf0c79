"""Imports every query module so that ``REGISTRY`` is complete."""

from matchframe.plans import (  # noqa: F401
    clean_queries,
    feature_queries,
    join_queries,
    model_queries,
    probability_queries,
    season_queries,
    source_queries,
    windows_queries,
)
from matchframe.plans.registry import REGISTRY

__all__ = ["REGISTRY"]

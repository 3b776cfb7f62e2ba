"""Import every query module so that the catalog is complete."""

from . import measure_queries, model_queries, pair_queries, panel_queries, scaling_queries, score_queries  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

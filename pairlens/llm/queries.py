"""All queries of the subpackage."""

from . import chat_query, decontam_query, lm_query, mixing_query, neardup_query, phrases_query, pii_query, quality_query, recompress_query, rules_query, runs_query, topk_query, urlfilter_query  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

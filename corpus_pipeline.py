"""The corpus pipeline's stages, as textquarry.llm.pipeline has them."""

from __future__ import annotations

from textquarry.llm.pipeline import ORACLE_SQL, STAGES, run
from textquarry.llm.queries import pipeline_queries as queries

__all__ = ["ORACLE_SQL", "STAGES", "queries", "run"]

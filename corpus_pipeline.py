"""The corpus pipeline: STAGES over documents, and run() for all of them."""

from __future__ import annotations

from fathomic.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

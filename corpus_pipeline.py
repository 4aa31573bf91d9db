"""The corpus pipeline's entry; its stages are in ``treeloom.llm.pipeline``."""

from treeloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

"""The corpus pipeline: its stages are in the subpackage of the operators."""

from brindle.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]

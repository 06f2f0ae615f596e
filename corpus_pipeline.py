"""The corpus pipeline over the documents table; its stages are in stemma.llm.pipeline."""

from stemma.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, lines, mixture, near_duplicates, packed, quality, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "lines", "mixture", "near_duplicates", "packed", "quality", "run"]

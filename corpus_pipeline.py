"""The corpus pipeline: its stages are in terrachron.llm.pipeline, as they belong to that subpackage."""

from terrachron.llm.pipeline import ORACLE_SQL, STAGES, run, written

__all__ = ["ORACLE_SQL", "STAGES", "run", "written"]

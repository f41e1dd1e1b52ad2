"""The corpus pipeline's stages; they are written in lodeworks.llm.pipeline."""

from lodeworks.llm.pipeline import ORACLE_SQL, STAGES, run

QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
__all__ = ["ORACLES", "ORACLE_SQL", "QUERIES", "STAGES", "run"]

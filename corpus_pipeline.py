"""The training-data pipeline over ``documents``; its stages stand in ``tiffin.llm.stages``."""

from tiffin.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

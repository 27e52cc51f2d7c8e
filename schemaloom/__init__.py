"""Schema linking data work as Spark DataFrame jobs.

functions  Column -> Column helpers (tokens, JSON text, prompts, token sequences)
operators  DataFrame -> DataFrame operators (catalog, retrieval, links, scoring, curation)
sources    readers and writers
plans      operators put together into whole jobs
"""

from schemaloom.config import RetrievalConfig, RunConfig

__all__ = ["RetrievalConfig", "RunConfig"]

"""All queries of this subpackage."""

from convqa.llm import q_conversations, q_mixing, q_models, q_search, q_shards, q_similar, q_text
from convqa.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "q_conversations", "q_mixing", "q_models", "q_search", "q_shards", "q_similar", "q_text"]

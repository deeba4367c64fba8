"""Operators for preparing training data, and the queries that apply them to the test tables."""

from lullmap.llm import (
    alignment,
    chat,
    decontaminate,
    exact_dedup,
    jaccard,
    packing,
    phrases,
    quality,
    secrets,
    sharding,
    suffixes,
    toxicity,
    winnowing,
)
from lullmap.llm.common import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "alignment", "chat", "decontaminate", "exact_dedup", "jaccard", "packing", "phrases", "quality", "secrets", "sharding",
    "suffixes", "toxicity", "winnowing",
]

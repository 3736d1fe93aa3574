"""Operations of a training-data pipeline: scoring, deduplication, decontamination, redaction, tokens, fixity."""

from repoindex.llm.oracle import ORACLES
from repoindex.llm.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from tidemark.llm.contracts import QUERIES
from tidemark.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

"""Operators for preparing training data. Nothing else in the library imports this package."""

from codeloom.llm.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

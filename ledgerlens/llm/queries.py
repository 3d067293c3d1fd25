"""Queries of the operators over the given tables, one per operator."""

from . import q_chat, q_divergence, q_licenses, q_native, q_negatives, q_texts, q_tokens  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

"""Imports every module that registers queries."""

from . import q_compose, q_landed, q_macro, q_models, q_more, q_music, q_resolve, q_signal, q_sound, q_stats, q_text, q_vectors, q_writes  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

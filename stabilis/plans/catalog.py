"""The registered queries of the library and their SQL for DuckDB."""

from . import queries_ddg, queries_files, queries_model, queries_sequences, queries_statistics, queries_trees  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

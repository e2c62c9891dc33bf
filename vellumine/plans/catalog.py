"""All queries of the library's own operators, and their SQL."""

from . import evaluation, normalisation, relations, texts  # noqa: F401  (they register their queries)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

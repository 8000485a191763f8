"""All registered queries."""

from . import tables_sql  # noqa: F401  isort: skip
from . import evaluation, external, features, portfolios, screens, sources, streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

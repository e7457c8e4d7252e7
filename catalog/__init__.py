"""Every registered query with, where SQL can say it, the SQL that must give the same rows."""

from catalog import clean, explore, features, models, plots, profile, sources  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Registry of the engine's queries and their SQL."""

from . import evidence, functions, identity, markup, quality, roundtrips, rows, runs, star, work  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

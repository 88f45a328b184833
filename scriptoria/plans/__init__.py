"""Registered queries and surrogate tables."""

from . import queries, changes, styles, layouts, records  # noqa: F401, I001  (the others register their queries in the first)

"""The registered queries over the given tables, with their SQL."""

from . import queries, results  # noqa: F401

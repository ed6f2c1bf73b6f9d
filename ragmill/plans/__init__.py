"""All queries of the library: importing the modules registers them."""

from . import curation, files, reports, retrieval, scalars, streams, tables  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

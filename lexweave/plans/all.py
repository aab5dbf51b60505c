"""Every registered query."""

from . import (  # noqa: F401
    agents, files, inference, ordering, preparation, retrieval, streams, tracking, training,
)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

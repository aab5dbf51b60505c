"""Spark DataFrame operators for the data work around language models."""

import sys

from pyspark import cloudpickle

from .config import ChunkConfig, ColumnMap, PrepConfig, RetrievalConfig, SplitConfig

# Functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ChunkConfig", "ColumnMap", "PrepConfig", "RetrievalConfig", "SplitConfig"]

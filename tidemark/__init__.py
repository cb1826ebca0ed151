"""Tidemark: DataFrame operators for web analytics and online experiments on Spark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from tidemark.session import build_session

# Functions sent to Python workers travel whole, so executors need no installed copy.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]

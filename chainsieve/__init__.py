"""Spark-native selection, scoring and evaluation analytics for scored text chains."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so executors
# need no copy of the package on their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["__version__"]
__version__ = "0.1.0"

"""Spark-native analytics over correspondence: threads, labels, predictions and training text."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel whole, so that workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

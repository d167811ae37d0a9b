"""Spark-native analytics over agent session traces."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
__version__ = "0.2.0"

"""A PySpark-native engine for agent conversations, run telemetry and training data."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value: a cluster's workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

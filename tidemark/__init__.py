"""PySpark-native analytics over agent and user-interface security events."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: a cluster needs no copy of it there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

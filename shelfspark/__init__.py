"""Spark-native analytics over bibliographic collections."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions of this package travel to Python workers by value, so executors need no copy of it on their path
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

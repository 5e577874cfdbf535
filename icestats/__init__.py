"""Spark-native data operators for ice hockey and other two-sided events."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions sent to executors travel with the task, so executors need no copy of the package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

"""A record-query engine on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to Python workers by value: executors need not have it on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

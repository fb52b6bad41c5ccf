"""Reactive time-series graphs on Spark: declare nodes, compile to DataFrames."""

from pyspark import cloudpickle as _cloudpickle

# Functions sent to executors travel by value, so that workers need not have
# this package on their own path.
_cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["_"]))

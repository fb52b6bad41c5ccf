"""Operators for building training corpora.

Every operator is a function from DataFrames to a DataFrame. ``QUERIES`` and
``ORACLES`` (module ``queries``) apply them to whole tables. Nothing else in
the library imports this subpackage.
"""

from pyspark import cloudpickle as _cloudpickle

# Functions sent to executors travel by value, so that workers need not have
# this package on their own path.
_cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["_"]))

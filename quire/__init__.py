"""quire: build and query text-retrieval corpora with Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run inside Python workers (pandas UDFs, mapInPandas bodies)
# are shipped by value with the task, so executors need no copy of this
# package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"

"""Spark-first property-graph analytics: graphs are plain DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a job
# needs no copy of the package on the workers' path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

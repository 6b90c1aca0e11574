"""Heap-trace analytics on Spark: load event logs, ask questions about sets of objects."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

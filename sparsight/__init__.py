"""Sparse-feature retrieval analytics as ordinary Spark jobs.

Every operator is a function from DataFrames to a DataFrame.  Keys are always
columns (never positions), scans and sinks are tables, and NumPy only appears
inside Arrow batches that Spark has already partitioned.
"""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so a cluster needs no copy
# of this package next to its Python workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

"""Tie-point, raster and catalog analytics for planetary image registration, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

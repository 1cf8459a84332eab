"""Time-series analytics on Spark DataFrames, one series or millions."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Interval and activity analytics over very many series, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with the job, so that executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

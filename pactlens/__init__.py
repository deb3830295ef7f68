"""Contract analytics on Spark: traffic, specifications, client code and deprecations as DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

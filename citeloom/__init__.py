"""citeloom: growing and analysing citation networks with PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions with the tasks, so that they need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

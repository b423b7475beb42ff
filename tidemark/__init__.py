"""Spark-native analytics over timed media catalogs and the evidence about them."""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with the job, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Spark-native analytics for corpora of ordered event sequences and texts."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with the task, so the package needs no installation there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

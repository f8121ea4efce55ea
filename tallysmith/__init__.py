"""Spark-native evaluation analytics: scoring, significance, agreement, coverage and de-duplication."""

import sys

from pyspark import cloudpickle

# Python helpers travel to the executors inside the job, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""vellumine: a Spark-native engine for document records and training-data pipelines."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the task, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

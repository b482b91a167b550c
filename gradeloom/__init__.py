"""Spark-first analytics over a corpus of reviewed documents and events."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code: executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

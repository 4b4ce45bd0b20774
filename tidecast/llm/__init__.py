"""Operators for building training data; nothing else in the library imports this folder."""

import sys

from pyspark import cloudpickle

# Task code goes to the executors by value, so that they need not have this folder installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

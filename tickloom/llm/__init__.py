"""Operators for preparing large text corpora for training. Nothing else in the package imports this one."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel whole, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Structured documents as DataFrames: parse, protect, segment, translate, rebuild."""

import sys

from pyspark import cloudpickle

# Workers get the code with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

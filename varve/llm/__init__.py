"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of these modules travel with the task, so executors need no copy of the library.
register_pickle_by_value(sys.modules[__name__])

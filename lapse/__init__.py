"""Lapse: customer-inactivity analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

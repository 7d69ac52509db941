"""Hybrid document navigation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry their code, so that workers need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

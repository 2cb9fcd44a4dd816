"""Marginalia: content-based recommendation analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so only the driver needs the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Spark-native data operators for logs, filings, articles and table sync."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in tasks travel with them, so that executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

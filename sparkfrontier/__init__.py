"""Spark-native analytics for web-crawl frontiers and crawl logs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry their code along, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

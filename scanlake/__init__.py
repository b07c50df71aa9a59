"""Spark-first analytics for LiDAR, radar and camera sensor logs.

Functions handed to Python workers are pickled by value, so executors need not
have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

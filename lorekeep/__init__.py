"""lorekeep: a PySpark-native engine for organisational knowledge.

Functions of this package are sent to executors by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

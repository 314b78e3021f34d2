"""A Spark-native medallion, equipment-analytics and retrieval engine.

Operators are plain ``DataFrame -> DataFrame`` functions.  Nothing here starts a
session, collects a growing result or writes outside the paths it is given.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so that executors need
# no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

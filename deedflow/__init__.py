"""Record-document analytics expressed as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions for executors travel by value, so that workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

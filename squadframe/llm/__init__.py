"""Operators for building language-model training data; nothing outside this folder imports it.

Their functions are sent to the executors by value, so a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

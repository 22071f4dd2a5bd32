"""Operators for building language-model training data; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the Python workers by value, so a
# cluster needs no copy of the package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

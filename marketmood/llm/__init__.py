"""Operators of a large-scale training-data pipeline over documents and pages.

Functions that run in Python workers are pickled by value, so executors need no copy
of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage. Its functions are pickled
by value, so that executors need no copy of it on their path.
"""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

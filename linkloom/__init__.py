"""linkloom: link-quality analytics on Spark DataFrames.

Its functions are pickled by value, so executors need no copy of the package.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Functions that run on executors are pickled by value, so an
executor needs no copy of this package on its import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

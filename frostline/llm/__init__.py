"""Operators for building training corpora. Nothing outside this subpackage imports it.

Task functions travel to the executors with their helpers, so that workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

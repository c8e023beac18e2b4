"""Training-data operators.

Functions of this subpackage travel to executors by value, so a cluster needs no copy of the
repository on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

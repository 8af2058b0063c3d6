"""pixelspark: gridded image analytics as Spark relations.

Functions that run on executors are pickled by value, so a cluster needs no installed copy.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])

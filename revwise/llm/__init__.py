"""Operators for training-data pipelines (sharding, search, dedup, mixing, packing, ...).

Nothing else in the library imports this subpackage.  Functions that run inside
Spark's Python workers are shipped by value, so a job started from any folder
finds them on the executors without installing the package there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators of a training-data pipeline.

Functions of this subpackage travel to the executors by value, so a cluster needs only the
public libraries, not this package, on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

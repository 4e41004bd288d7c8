"""Operators for training-data pipelines: one module per operator, its registered query beside it.

Nothing outside this package imports it. Functions that run inside Spark tasks are sent along
by value, so executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

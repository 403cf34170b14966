"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Worker functions of this subpackage are pickled by value, so that executors need no copy of it
on their own import path.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])

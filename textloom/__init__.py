"""textloom: a PySpark-native engine for hybrid text retrieval and its data preparation.

Worker functions are pickled by value, so that executors need no copy of the package on their import path.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])

"""pairloom: a PySpark-native engine for record matching, deduplication and pair scoring."""

import sys

from pyspark import cloudpickle

# Functions run by Python workers travel with their task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

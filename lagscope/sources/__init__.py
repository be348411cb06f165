"""Sources: files, documents, linked tables and score tables."""

import sys

from pyspark import cloudpickle

# task functions go to executors by value, so a cluster needs no copy of the repository
cloudpickle.register_pickle_by_value(sys.modules[__name__])

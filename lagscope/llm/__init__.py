"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage.  Task functions are shipped
to executors by value, so a cluster needs no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

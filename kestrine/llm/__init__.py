"""Operators for preparing training corpora.

The package is pickled by value, so that executors need no copy of it on
their own path; its tables are read and written by Spark alone.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

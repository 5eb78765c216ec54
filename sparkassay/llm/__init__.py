"""Operators for preparing training data. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the query, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

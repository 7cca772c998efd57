"""Queries over the given tables and the SQL each must agree with, one module per operator family."""

import sys

from pyspark import cloudpickle

# The stand-in models run in Python workers, which need not have this folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

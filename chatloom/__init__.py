"""chatloom: instruction-tuning data preparation and evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the Python workers by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

"""Analytics on Spark for how code changes over time, and for training data at scale."""

import sys

from pyspark import cloudpickle

# what runs in Python workers is sent to them by value, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

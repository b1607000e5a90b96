"""ledgerlark: civic-records analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, so it need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""kinelake: a PySpark-native engine for multichannel motion time series."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

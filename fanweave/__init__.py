"""Dense-network inference and keyed fan-in as Spark DataFrame jobs."""

import sys

from pyspark.cloudpickle import cloudpickle

# functions of this package travel inside the tasks, so workers need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])

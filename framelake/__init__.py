"""framelake: Spark-native analytics over sprite frames, timelines and production records."""

import sys

from pyspark import cloudpickle

# Helpers used inside tasks travel with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

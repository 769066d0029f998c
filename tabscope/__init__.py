"""tabscope: exploratory table analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so the executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

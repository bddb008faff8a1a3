"""Source-code index, search and review analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions handed to tasks travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

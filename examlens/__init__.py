"""examlens: exam-document analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Small Python helpers travel with the task, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Model-compression analytics as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Per-row helpers travel with the tasks, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Physiological-waveform analytics as plain Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Helper functions travel to the executors inside the task, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

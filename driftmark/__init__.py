"""Driftmark: session-transcript and corpus analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code: no install there is needed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

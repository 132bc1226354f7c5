"""Signals from posts, documents, media and reviewer feedback, computed with Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python functions that run in tasks travel with them, so workers need not have this
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

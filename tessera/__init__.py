"""Spark jobs for language-model training tables and feedback data."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks carry their helpers along, so executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

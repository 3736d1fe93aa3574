"""Index repositories and document corpora on Spark and search them in batch."""

import sys

from pyspark import cloudpickle

# Executors get the few Python functions by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

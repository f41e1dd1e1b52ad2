"""Artifact and corpus analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so that a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

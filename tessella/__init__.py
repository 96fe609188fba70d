"""Spark-first analytics over scored features, event logs, rasters and routes."""

import sys

from pyspark import cloudpickle

# functions travel to executors with their code, which need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

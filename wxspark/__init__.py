"""Station time series on Spark: ingest, features, forecasting models, ensembles and evaluation."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with their code, so workers need no copy of this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

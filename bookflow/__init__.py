"""Spark jobs for order-book and trade tables: cleaning, features, signals, backtests."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Helpers travel to the Python workers with the plan, so the workers need no copy of this package on their path.
register_pickle_by_value(sys.modules[__name__])

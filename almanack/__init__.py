"""Spark-native jobs over event-listing data.

Every public function takes and returns DataFrames or Columns, has an explicit
reference time, and leaves the physical plan to Spark.
"""

import sys

from pyspark import cloudpickle

from almanack.session import build_session, durable, shared_path

# Functions of this package travel to executors by value, which need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "durable", "shared_path"]

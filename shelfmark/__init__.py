"""Shelfmark: text catalogues on Spark.

Cleaning, deduplication, chunking, indexing, record matching, retrieval,
page extraction, incremental sync and evaluation, all as DataFrame
transformations that answer many queries in one job.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Functions of this package travel to executors by value, so that workers need
# neither the package on their path nor the driver's working directory.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

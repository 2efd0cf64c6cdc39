"""Spark-native curation, risk analytics and latent-vector operators.

Every public function takes and returns Spark DataFrames or Columns.  Nothing
here keeps rows on the driver: the driver plans, counts and loops over bounded
iteration counts, while all row work runs as Spark jobs.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

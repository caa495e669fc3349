"""strandcut: segmentation of ordered data with Spark DataFrames.

Line images, label files and plain tables are cut into overlapping slices,
labelled, scored, merged into spans, evaluated and laid out for review.
Every operator takes a DataFrame plus column names and returns a lazy
DataFrame.
"""

import sys

from pyspark import cloudpickle

from strandcut.session import get_session

# Kernels travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session"]

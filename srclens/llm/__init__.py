"""Operators for large-scale training-data preparation; see each module."""

import sys

from pyspark import cloudpickle

# Tasks get these functions with the job: executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

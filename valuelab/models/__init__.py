"""Models on a numeric target and on its high-value label, and their metrics."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

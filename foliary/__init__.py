"""Document-evidence analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Small helpers that run inside Arrow UDFs travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""A text-corpus and evaluation engine on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their code, so that executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

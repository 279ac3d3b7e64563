"""sievemill: curation and selection analytics over generated-text tables, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Corpus integrity and style analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Workers need no copy of the package: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

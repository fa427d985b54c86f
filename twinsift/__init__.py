"""twinsift: look-alike class mining and geo-enriched dataset curation on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operations of a training-data pipeline.  Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions travel with their code, so workers need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

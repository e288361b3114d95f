"""casemill: document labelling and classifier data sets as Spark DataFrames.

Every operator is a function from DataFrame (or Column) to DataFrame (or Column); nothing is
executed until the caller runs an action.
"""

import sys

from pyspark import cloudpickle

# The few batch functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

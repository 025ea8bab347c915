"""keepsake: catalogue work over digitised collections, written as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get our small helpers with the task, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

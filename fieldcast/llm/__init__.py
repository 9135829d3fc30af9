"""Operators for training-data preparation.

Nothing else in the library imports this subpackage. Each module holds one
operator with its general interface; ``queries`` has the registered queries.
"""

import sys

from pyspark import cloudpickle

# Tasks get this subpackage's functions with the job, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

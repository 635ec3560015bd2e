"""Operators a training-data pipeline needs on top of the register library.

Nothing else in ``prospect`` imports this package.  Each module holds one
operator with its own general interface; ``registry`` binds the thin
``opN_*`` queries to the tables.
"""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside tasks are sent by value, so
# executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

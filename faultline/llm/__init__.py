"""Operators that prepare training data for language models.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# The functions that run in Python workers travel to the executors with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for training-data pipelines over text tables.

Nothing else in the library imports this package. Functions that run in tasks are pickled by value,
so executors need the listed libraries (numpy, pyarrow, tiktoken) but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

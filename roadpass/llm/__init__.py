"""Operators that prepare text and vectors for training language models.

Tasks carry this package's code with them, so executors need no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

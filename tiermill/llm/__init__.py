"""Operators that prepare text corpora; nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions run in tasks travel with the tasks, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

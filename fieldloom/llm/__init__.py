"""Operators for preparing training text at scale; nothing else in the package imports them.

Functions that run in tasks are sent by value, so that executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

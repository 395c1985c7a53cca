"""Operators for preparing training text. Nothing else in the library imports this package.

Executors need not have the package: its functions travel with the tasks.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""stackquarry - infrastructure-knowledge analytics as Spark jobs.

Every operator maps DataFrames to DataFrames; nothing here reads the wall clock
or collects data whose size grows with the input.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so the package does not
# have to be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

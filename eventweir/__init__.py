"""Event collection, routing and compaction as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function (or a ``Column``
expression) with explicit parameters: no clocks, no globals, no collected
data.  ``plans`` and ``streaming`` put them together into whole jobs.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel with the job, so executors
# do not need this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

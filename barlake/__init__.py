"""Daily price bars and security universes on Spark.

Functions that Spark runs in Python workers travel with the job: the package is pickled by value, so a
cluster needs no copy of it on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Privacy-first web and product analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

from footfall.session import configure, get_spark, shared_folder

# Workers get the few Python helpers with the job itself; the package need not be installed
# on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["configure", "get_spark", "shared_folder"]

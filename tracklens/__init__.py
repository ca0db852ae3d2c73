"""Spark jobs that audit very large media libraries held as tables."""

import sys

from pyspark import cloudpickle

#: Executors need not have this package: its functions travel with the tasks that use them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

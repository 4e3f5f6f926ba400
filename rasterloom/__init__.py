"""rasterloom: image comparison, OCR layout and asset lifecycle as Spark jobs."""

import sys

from pyspark import cloudpickle

# Executors receive the functions of this package with the job and need no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""quillspark: text-corpus preparation, detector scoring and cohort statistics as Spark jobs.

Every public function takes and returns DataFrames (``df.transform(f)`` style) or Columns.
"""

import sys as _sys

__version__ = "0.1.0"

# Functions that run inside Python workers (mapInPandas kernels) are shipped with each task by
# value, so executors need no installed copy of this package (like shipping it with --py-files).
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError):  # older serializers: the package must then be on the workers' path
    pass

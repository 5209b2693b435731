"""quillon: code-search analytics and corpus preparation on PySpark.

Functions of this package that run in Python workers are pickled by value, so
executors need no copy of the package itself.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Loomgraph: code-graph analytics expressed as Spark DataFrame plans.

The package is registered with Spark's pickler so that functions shipped to
Python workers travel by value: executors need numpy and pyarrow, but no copy
of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

"""timberflow: log analytics expressed as Spark DataFrame operators.

Every public operator takes and returns DataFrames (or Columns), so Catalyst
sees one declarative plan from scan to sink.
"""

from pyspark import cloudpickle as _cloudpickle

# Arrow UDF bodies travel by value, so executors need no copy of this package.
import sys as _sys

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"

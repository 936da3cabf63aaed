"""letterloom: a PySpark-native engine for e-mail and text corpora.

Functions that run inside Python workers are pickled by value, so a cluster needs only PySpark,
pyarrow, numpy and pandas on its executors, not this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

"""Operators of a training-data pipeline, one module each, with their registered queries.

Nothing outside this subpackage imports it. Its task functions travel by value, so that executors need no copy of
the library.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

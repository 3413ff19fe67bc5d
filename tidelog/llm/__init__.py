"""Operators for large text corpora. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions sent to them carry their code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

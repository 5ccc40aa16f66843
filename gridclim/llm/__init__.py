"""Operators for training-data corpora: near duplicates, quality, tokens, shards, packing.

Nothing else in the library imports this subpackage. Its functions run inside Spark's Python
workers; they travel by value, so executors need no copy of the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Foliant: document corpora on Spark.

Reads documents as tables, cleans and chunks their text, attaches embeddings,
answers top-k similarity queries and keeps named corpora with their
question-and-answer logs.  Every operator is a function from DataFrame or
Column to DataFrame or Column.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to the Python workers by value, so the
# executors need no installed copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

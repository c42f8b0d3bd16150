"""Similarity analytics over large telemetry tables, written for Spark.

Every stage takes and returns keyed DataFrames:

* ``telemap.sources``    read and write stage tables
* ``telemap.functions``  column expressions (command lines, tokens, labels)
* ``telemap.operators``  curation, bags, weights, co-occurrence, neighbours,
  embeddings, layouts, clusters, labels and map alignment
* ``telemap.streaming``  the curation and binning steps on streams
* ``telemap.plans``      whole studies and the registered queries
"""

import sys

from pyspark import cloudpickle

from telemap.session import cut, session

# Functions that run in Python workers travel with the plan, so executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["cut", "session"]

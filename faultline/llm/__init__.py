"""Training-data operators: near-duplicates, fingerprints, repeated passages,
personal data, toxicity, quality, language, source mixing, packing and exact
vector search. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so those need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

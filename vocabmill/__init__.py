"""A Spark-native engine that maps clinical terms to standard vocabularies."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Training-data operators: line and substring dedup, decontamination,
toxicity, token output, mixing, chat formatting, SimHash, language ID, top-k.

Nothing outside this package imports it; ``queries`` holds its registered
queries.  Functions sent to executors are pickled by value, so a cluster does
not need the package installed on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Training-data operators: toxicity, near-dedup, repeated passages, quality, sharding,
packing, nearest neighbours, decontamination, WARC and personal data.

Nothing else in the library imports this subpackage.  Functions sent to executors are
pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

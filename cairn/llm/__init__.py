"""Operators for preparing language-model training data.

Nothing outside this package imports it. Functions that run inside tasks travel to the executors
with the job, so a cluster needs numpy and Arrow but no installed copy of this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Training-data operators: quality, decontamination, deduplication, language models, packing and archives.

Nothing outside this subpackage imports it.  Each module holds one operator with a general interface and the
thin ``opN_<name>`` query that applies it to the driver's tables.
"""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with their code, so that those need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

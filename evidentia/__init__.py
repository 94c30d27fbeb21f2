"""evidentia: evidence retrieval and claim verification over text corpora, on Spark.

Functions that run on executors are pickled with their code, so a cluster needs no
installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

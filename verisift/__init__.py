"""Document-verification analytics on PySpark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors carry their code with them: no executor needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

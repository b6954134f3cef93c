"""reamwork: document and data-format conversion over whole corpora, on Spark."""

from pyspark import cloudpickle

# Python functions of this package travel to the workers with their code, so the package need not
# be installed there.
cloudpickle.register_pickle_by_value(__import__(__name__))

__version__ = "0.1.0"

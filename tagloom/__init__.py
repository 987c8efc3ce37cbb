"""tagloom: annotated-corpus analytics as PySpark DataFrame transforms.

Functions of this package are shipped to executors by value, so they work
wherever the driver can import them, without installing the package there.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Column expressions, and small numpy helpers that Arrow UDFs send along by value, so
executors need no installed copy of this package."""

from pyspark import cloudpickle

from panelyard.functions import linear, moments, tails

for _module in (linear, moments, tails):
    cloudpickle.register_pickle_by_value(_module)

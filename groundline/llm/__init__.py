"""Operators for preparing training data: filters, de-duplication, scans, tokenising, mixing."""

from pyspark import cloudpickle

import groundline

# Functions travel to the executors by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(groundline)

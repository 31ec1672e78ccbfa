"""Operators of a training-data pipeline."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for training-data pipelines. Nothing else in the library imports this package."""

from pyspark import cloudpickle

import riskloom

# Task-side helpers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(riskloom)

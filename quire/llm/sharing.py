"""Objects of this library sent to the tasks once."""

from __future__ import annotations

import pickle

from pyspark import cloudpickle
from pyspark.sql import SparkSession


class Shared:
    """A broadcast object. It travels with its class, so that workers need
    not be able to import this library; ``value`` unpacks it once per task."""

    def __init__(self, spark: SparkSession, value):
        self._packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = None

    def __getstate__(self):
        return self._packed

    def __setstate__(self, packed):
        self._packed, self._value = packed, None

    @property
    def value(self):
        if self._value is None:
            self._value = pickle.loads(self._packed.value)
        return self._value

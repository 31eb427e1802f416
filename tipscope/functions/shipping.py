"""Functions of a module sent to Python workers by value, so that executors
need not have this package installed."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)

"""dayglass: user-behaviour risk analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

from .config import EngineConfig, fixture_config

# Functions of this package travel to Python workers by value, so that executors need no copy
# of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["EngineConfig", "fixture_config"]

"""Theme discovery over large text tables, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from themeloom.plans.model import ThemeModel, run  # noqa: E402

__all__ = ["ThemeModel", "run"]

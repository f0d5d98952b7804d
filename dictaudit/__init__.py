"""dictaudit — quality checks for large terminology dictionaries, as Spark DataFrame operators."""

import sys as _sys

__version__ = "0.1.0"

# Python stages (Arrow kernels) are defined in this package. Pickling them by value ships their
# code with each task, so executors need numpy/pandas/pyarrow but not this package on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to importing on the workers
    pass

"""Spark engine for hourly count series: ingest, features, forecasts,
ledgers, monitoring queries and canonical history, as DataFrame plans."""

import sys as _sys

try:  # ship this package's Python functions (UDF bodies, stateful processors) by value,
    # so executors need not have the package installed or on their path
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older pyspark: fall back to --py-files / PYTHONPATH
    pass

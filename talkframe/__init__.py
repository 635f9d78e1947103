"""talkframe: set-at-a-time transcript search and retrieval evaluation on Spark DataFrames."""

import sys as _sys

__version__ = "0.1.0"

# Python workers do not need the package installed: functions of this package used in
# pandas UDFs / applyInPandas / mapInPandas are pickled by value and travel with the task.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to an installed package
    pass

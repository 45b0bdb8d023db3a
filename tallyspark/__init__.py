"""tallyspark: ledger cleaning and financial analytics as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function or a ``Column`` expression,
so Catalyst plans it and the same code runs on a laptop sample or a cluster.
"""

__version__ = "0.1.0"

# Ship the package's functions to Python workers by value (pandas UDFs, mapInPandas), so
# executors need no installed copy and the driver may run from any directory.
try:  # pragma: no cover - depends on the pyspark build
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass

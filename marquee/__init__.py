"""marquee: a PySpark engine for rating data and hybrid recommendations.

Every operator is a function from DataFrame(s) to DataFrame, composed lazily so
Catalyst sees the whole plan. Python workers are used only for the dense
linear-algebra blocks (factor training and blocked top-k scoring).
"""

__version__ = "0.1.0"

# Functions of this package that run inside Python workers (the pandas blocks)
# are pickled by value, so executors need no installed copy of the package.
try:  # pragma: no cover - depends on the pyspark build
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass

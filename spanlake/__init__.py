"""spanlake: full-text search, ranking and span algebra as Spark DataFrame plans."""

from __future__ import annotations

_shipped: set = set()


def ship(spark) -> None:
    """Give this package to the executors' Python workers, once per application."""
    import os
    import tempfile
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spanlake-ship-"), "spanlake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    at = os.path.join(folder, n)
                    z.write(at, os.path.join("spanlake", os.path.relpath(at, here)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def ship_active() -> None:
    """ship() for the session in use, where there is one: for functions that make Columns only."""
    from pyspark.sql import SparkSession

    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)

"""Rule tables, as small DataFrames of fixed size."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_TABLES: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, name: str, rows: list[tuple], schema: str) -> DataFrame:
    """A rule table of the application; its size is that of the literals in this package."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _TABLES:
        _TABLES[key] = spark.createDataFrame(rows, schema)
    return _TABLES[key]


def once_each(build: Callable) -> Callable:
    """build(*args) once for each application and arguments, as Columns live in its JVM."""
    made: dict[tuple, object] = {}

    @wraps(build)
    def held(*args):  # noqa: ANN002, ANN202
        app = SparkContext._active_spark_context.applicationId
        if (app, *args) not in made:
            for old in [k for k in made if k[0] != app]:
                del made[old]
            made[(app, *args)] = build(*args)
        return made[(app, *args)]

    return held

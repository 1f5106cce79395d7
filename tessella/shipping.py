"""Makes this package importable in Python workers, wherever they run and whatever their working folder is."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application's files, once an application; executors fetch them from the driver."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="tessella-")) / "tessella.zip"
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(_PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow where ``run`` may use this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)

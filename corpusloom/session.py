"""A Spark session with the settings that the engine expects."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once per application: their Python need not have it installed."""
    if getattr(spark.sparkContext, "_corpusloom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    name = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom_code.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(name))
    spark.sparkContext._corpusloom_shipped = True


def get_session(app_name: str = "corpusloom", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; further settings by keyword, dots as double underscores."""
    builder = SparkSession.builder.appName(app_name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()

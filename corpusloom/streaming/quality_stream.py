"""The quality filter on a stream of corpus files: an extension, as it needs no order and no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import quality


def read_stream(spark: SparkSession, folder: str, separator: str = "\n\n") -> DataFrame:
    """Documents of the files that arrive in a folder."""
    return spark.readStream.format("text").option("lineSep", separator).load(folder).select(F.col("value").alias("text"))


def filter_stream(docs: DataFrame, **limits: float) -> DataFrame:
    """Accepted documents, stripped, without inner blank lines."""
    good = quality.judged(docs, **limits).filter(F.col("reason").isNull())
    return good.select(tx.close_blank_lines(F.col("text")).alias("text"))

"""Taking rows out of a wide table after a narrow verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bloom
from .stages import Stages


def keep_rows(docs: DataFrame, key: Column, verdicts: DataFrame, stages: Stages, order: list[Column]) -> DataFrame:
    """Rows of ``docs`` that stay by ``verdicts(key, kept)``, which has a row for each row of ``docs``.

    Keys of which a row goes are put into a bounded Bloom filter; documents that it
    excludes stay without being shuffled.  The others meet the verdicts of their
    keys: as many of a key's rows stay as were kept, the first by ``order``.
    """
    groups = verdicts.groupBy("key").agg(F.count_if("kept").alias("__stay"), F.count("*").alias("n")).filter(F.col("__stay") < F.col("n"))
    groups = stages.write(groups.select(F.col("key").alias("__of"), "__stay"))
    n_blocks = bloom.n_blocks_for(groups.count())
    d = bloom.probe(docs.withColumn("__key", key), "__key", bloom.build(groups, "__of", n_blocks), n_blocks, "__maybe")
    sure = d.filter(~F.col("__maybe"))
    doubtful = d.filter("__maybe").join(groups, F.col("__key") == F.col("__of"), "left")
    doubtful = doubtful.withColumn("__r", F.row_number().over(W.partitionBy("__key").orderBy(*order))).filter(F.col("__stay").isNull() | (F.col("__r") <= F.col("__stay")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return sure.select(*columns).union(doubtful.select(*columns))

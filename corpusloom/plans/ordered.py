"""Order-dependent columns without a window over the whole table.

Rows are put into buckets that follow the order.  Windows run within a bucket;
what crosses buckets comes from a table with a row for each bucket, whose number
is bounded, and is added by a broadcast join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BUCKETS = 1024


def by_range(df: DataFrame, key: str, name: str = "bucket", n: int = BUCKETS) -> DataFrame:
    """Bucket a numeric key by equal widths between its least and greatest value."""
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    if lo is None:
        return df.withColumn(name, F.lit(0))
    width = max(1, -(-(int(hi) - int(lo) + 1) // n))
    return df.withColumn(name, F.floor((F.col(key) - F.lit(lo)) / width).cast("int"))


def running(df: DataFrame, totals: dict[str, Column], order: list, within: list[str] = (), bucket: str = "bucket") -> DataFrame:
    """Add exclusive running sums, ``totals`` by name, along ``order`` (in each group of ``within``)."""
    keys = [*within, bucket]
    sums = df.groupBy(*keys).agg(*[F.sum(v).alias(f"__t_{k}") for k, v in totals.items()])
    before = (W.partitionBy(*within) if within else W.partitionBy()).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in totals])
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    d = df.withColumns({f"__i_{k}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in totals.items()})
    d = d.join(sums if within else F.broadcast(sums), keys)
    return d.withColumns({k: F.col(f"__b_{k}") + F.col(f"__i_{k}") for k in totals}).drop(*[f"__{p}_{k}" for p in "bi" for k in totals])


def running_max(df: DataFrame, name: str, value: Column, order: list, bucket: str = "bucket") -> DataFrame:
    """Add the inclusive running maximum of ``value``."""
    tops = df.groupBy(bucket).agg(F.max(value).alias("__top"))
    tops = tops.select(bucket, F.max("__top").over(W.partitionBy().orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    d = df.withColumn("__inside", F.max(value).over(W.partitionBy(bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    d = d.join(F.broadcast(tops), bucket)
    return d.withColumn(name, F.coalesce(F.greatest("__inside", "__before"), "__inside", "__before")).drop("__inside", "__before")


def neighbours(df: DataFrame, columns: list[str], order: list, bucket: str = "bucket") -> DataFrame:
    """Add ``prev_<c>`` and ``next_<c>``: values of the row before and the row after."""
    row = F.struct(*columns)
    w = W.partitionBy(bucket).orderBy(*order)
    d = df.withColumns({"__prev": F.lag(row).over(w), "__next": F.lead(row).over(w)})
    key = F.struct(*order)
    edges = df.groupBy(bucket).agg(F.min_by(row, key).alias("first"), F.max_by(row, key).alias("last"))
    b = W.partitionBy().orderBy(bucket)
    edges = edges.select(bucket, F.lag("last").over(b).alias("__before"), F.lead("first").over(b).alias("__after"))
    d = d.join(F.broadcast(edges), bucket)
    prev, nxt = F.coalesce("__prev", "__before"), F.coalesce("__next", "__after")
    return d.withColumns({f"prev_{c}": prev[c] for c in columns} | {f"next_{c}": nxt[c] for c in columns}).drop("__prev", "__next", "__before", "__after")

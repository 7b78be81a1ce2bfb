"""Exact dedup of corpora that arrive one after the other, against a table of fingerprints that only grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.stages import Stages
from corpusloom.sources import files

_SCHEMA = "key binary, first_id {kind}, arrival int, bucket int"


class Fingerprints:
    """The first document of every key that has arrived, under one folder.

    An arrival adds a folder ``arrival=<n>`` with a file or more for each bucket of
    keys; folders of earlier ones are never written again.  One that was cut off has
    no ``_SUCCESS`` and is not read; admitting it again writes it anew.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int = 64):
        self.spark, self.path, self.id_type, self.buckets = spark, path.rstrip("/"), id_type, buckets

    def arrivals(self) -> list[int]:
        """Numbers of the arrivals that are whole."""
        if not files.exists(self.spark, self.path):
            return []
        fs, p = files._at(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        found = sorted(int(n.split("=")[1]) for n in names if n.startswith("arrival="))
        return [n for n in found if files.exists(self.spark, f"{self._folder(n)}/_SUCCESS")]

    def _folder(self, arrival: int) -> str:
        return f"{self.path}/arrival={arrival}"

    def table(self, before: int | None = None) -> DataFrame:
        """``(key, first_id, arrival, bucket)`` of whole arrivals (below ``before``)."""
        whole = [n for n in self.arrivals() if before is None or n < before]
        schema = _SCHEMA.format(kind=self.id_type)
        if not whole:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*[self._folder(n) for n in whole])

    def admit(self, docs: DataFrame, arrival: int, key: Column, id_col: str = "doc_id") -> DataFrame:
        """``docs`` with ``first_id`` and ``first_arrival``: the first document of equal ``key`` among all arrivals up to this one.

        Within an arrival the smallest id is first.  New keys are added to the table.
        Admitting a number again gives the same result: it is held against earlier
        arrivals only.  Keys have 128 bits (MD5); a null key is equal to no other.

        Only keys and ids are shuffled, and of the table no more than what the
        arrival's keys, grouped and written before, let the join keep: a small arrival
        is broadcast by its size, a large one is joined by bucket and key.
        """
        stages = Stages(self.spark, "arrival")
        d = docs.withColumn("__key", F.unhex(F.md5(key.cast("string"))))
        new = d.filter("__key is not null").groupBy("__key").agg(F.min(id_col).alias("__least"))
        new = stages.write(new.withColumn("__bucket", F.pmod(F.conv(F.substring(F.hex("__key"), 1, 4), 16, 10).cast("int"), F.lit(self.buckets))))
        old = self.table(arrival).select(F.col("key").alias("__key"), F.col("bucket").alias("__bucket"), F.col("first_id").alias("__old"), F.col("arrival").alias("__when"))
        known = stages.write(new.join(old, ["__bucket", "__key"], "left"))
        fresh = known.filter("__old is null").select(F.col("__key").alias("key"), F.col("__least").alias("first_id"), F.col("__bucket").alias("bucket"))
        fresh.repartition("bucket").sortWithinPartitions("key").write.mode("overwrite").partitionBy("bucket").parquet(self._folder(arrival))
        first = known.select("__key", F.coalesce("__old", "__least").alias("__first"), F.coalesce("__when", F.lit(arrival)).alias("__when"))
        out = d.join(first, "__key", "left")
        return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce("__first", F.col(id_col)).alias("first_id"), F.coalesce("__when", F.lit(arrival)).alias("first_arrival"))

    def kept(self, admitted: DataFrame, arrival: int, id_col: str = "doc_id") -> DataFrame:
        """The rows of an arrival that are the first of their key."""
        return admitted.filter((F.col("first_arrival") == arrival) & (F.col("first_id") == F.col(id_col))).drop("first_id", "first_arrival")

    def compacted(self, path: str) -> Fingerprints:
        """The same table with one file a bucket, in another folder; ``first_arrival`` of what has arrived so far is the last of its numbers there."""
        out, whole = Fingerprints(self.spark, path, self.id_type, self.buckets), self.arrivals()
        if whole:
            self.table().select("key", "first_id", "bucket").repartition("bucket").sortWithinPartitions("key").write.mode("overwrite").partitionBy("bucket").parquet(out._folder(whole[-1]))
        return out

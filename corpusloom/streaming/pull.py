"""Sources pulled as their files arrive, each until it has given its share.

A source may hold most of a stream, so its rows are not one state's: ranks within a
batch are made as in tables (buckets along the order, sums across them), and what a
source has given before is a row that the batch before has left.  A batch that was
cut off runs again under its number and overwrites what it left.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import mixing
from corpusloom.sources import files


class Pull:
    """Rows of a stream that its sources give up to their limits, under ``path``: ``batch=<n>`` folders of rows and of counts."""

    def __init__(self, spark: SparkSession, path: str, limits: Sequence[int], source: str = "source_id", order: str = "doc_id"):
        self.spark, self.path, self.limits, self.source, self.order = spark, path.rstrip("/"), list(limits), source, order

    def counts(self, batch: int) -> list[int]:
        """What each source has given up to a batch; a batch without counts is before the first."""
        at = f"{self.path}/counts/{batch}.txt"
        if batch < 0 or not files.exists(self.spark, at):
            return [0] * len(self.limits)
        return [int(x) for x in files.read_small(self.spark, at).split()]

    def last_batch(self) -> int:
        if not files.exists(self.spark, f"{self.path}/counts"):
            return -1
        return max((int(f.path.rsplit("/", 1)[-1].split(".")[0]) for f in files.list_files(self.spark, f"{self.path}/counts")), default=-1)

    def full(self, batch: int | None = None) -> bool:
        """Whether all sources have given their shares, so that nothing more need be read."""
        given = self.counts(self.last_batch() if batch is None else batch)
        return all(a >= b for a, b in zip(given, self.limits, strict=True))

    def take(self, batch: DataFrame, number: int) -> None:
        """One batch: rows in the order of the key within it go on from where the source stood."""
        before = self.counts(number - 1)
        listed = F.col(self.source).between(0, len(self.limits) - 1)
        at = (F.col(self.source) + 1).cast("int")
        given, limit = (F.element_at(F.array(*[F.lit(x).cast("long") for x in xs]), at) for xs in (before, self.limits))
        rows = batch.filter(listed).filter(given < limit)
        if all(a >= b for a, b in zip(before, self.limits, strict=True)):
            rows = rows.limit(0)
        ranked = mixing.ranked(rows.persist(), self.source, self.order)
        taken = ranked.withColumn("k", F.col("k") + given).filter(F.col("k") < limit)
        here = f"{self.path}/rows/batch={number}"
        taken.write.mode("overwrite").parquet(here)
        now = dict(self.spark.read.schema(taken.schema).parquet(here).groupBy(self.source).count().collect())
        counts = [a + now.get(i, 0) for i, a in enumerate(before)]
        files.write_small(self.spark, f"{self.path}/counts/{number}.txt", " ".join(map(str, counts)))
        rows.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d, available_now: bool = True) -> StreamingQuery:
        """Take a stream's batches, each after ``prepare`` (the quality filter, for one); go on where the checkpoint stands."""
        w = stream.writeStream.foreachBatch(lambda batch, number: self.take(prepare(batch), number)).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if available_now else w).start()

    def run(self, stream: DataFrame, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
        """All that is there now, or until every source has given its share."""
        query = self.start(stream, checkpoint, prepare)
        while not query.awaitTermination(1):
            if self.full():
                query.stop()
                return

    def rows(self) -> DataFrame:
        """``(.., k)`` of whole batches: a batch counts when its counts are there."""
        last = self.last_batch()
        if last < 0:
            raise FileNotFoundError(f"no batch at {self.path}")
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/batch={n}" for n in range(last + 1)]).drop("batch")

"""Durable stage tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.session import ship_code

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_local: dict[str, str] = {}
#: Seconds after which the next write has the driver collect its garbage.
COLLECT_AFTER = 5
_collected = 0.0


def _collect(spark: SparkSession, after: float = 0) -> None:
    """Broadcasts and shuffle files of plans that have run go when the driver has collected its garbage, and its heap shrinks."""
    global _collected
    if time.monotonic() - _collected >= after:
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="corpusloom-")
    return _local[app]


class Stages:
    """Writes stage tables and forgets them.

    ``write`` cuts the lineage: a lost executor costs a re-read of shared files,
    never a recomputation of the stages before.  ``drop`` removes tables that no
    later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_code(spark)
        _collect(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._paths: dict[int, str] = {}

    def write(self, df: DataFrame, batch_rows: int | None = None) -> DataFrame:
        """``batch_rows``: rows in a batch that Python gets, which bounds its memory where rows are wide."""
        _collect(self.spark, COLLECT_AFTER)
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        before = self.spark.conf.get(_BATCH)
        try:
            if batch_rows:
                self.spark.conf.set(_BATCH, batch_rows)
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_BATCH, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        self._keep = getattr(self, "_keep", [])
        self._keep.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete stage tables; only for tables that no pending plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = self._paths.pop(id(table), None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)

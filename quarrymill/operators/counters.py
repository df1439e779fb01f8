"""Counters as a log of increments, so that a batch that runs twice counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Counters:
    """K8: sums and latest values by key, at a path that all executors share.

    A batch is written under its number, with one row a key, and replaces what the same number wrote before. A compaction adds the batches
    up to a number to what was compacted before; batches up to it don't count any more, whether they are still there or are written again.
    One writer at a time. Null increments count as 0, null keys are one key.
    """

    def __init__(self, spark: SparkSession, path: str, sums: tuple[str, ...] = ("n",), latest: tuple[str, ...] = (), key: str = "key bigint") -> None:
        self.spark, self.path, self.sums, self.latest = spark, path, sums, latest
        self.key = key.split()[0]
        self.schema = ", ".join([key, *(f"{c} double" for c in (*sums, *latest)), "kind string", "batch long"])

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.key).agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in self.sums), *(F.max(c).alias(c) for c in self.latest))

    def _write(self, rows: DataFrame, kind: str, batch: int) -> None:
        self._merged(rows).write.mode("overwrite").parquet(f"{self.path}/kind={kind}/batch={batch}")

    def _rows(self) -> DataFrame:
        """All that is written; nothing where nothing was."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _counted(self, rows: DataFrame) -> int:
        """The number up to which batches are compacted."""
        return rows.where("kind = 'base'").select(F.max("batch")).first()[0] if rows.where("kind = 'base'").limit(1).count() else -1

    def add(self, batch: int, rows: DataFrame) -> None:
        """Increments (key, sums, latest) of the batch of a number from 0."""
        self._write(rows, "log", batch)

    def _live(self, upto: int | None = None) -> DataFrame:
        rows = self._rows()
        base = self._counted(rows)
        late = (F.col("kind") == "log") & (F.col("batch") > base)
        return rows.where(((F.col("kind") == "base") & (F.col("batch") == base)) | (late if upto is None else late & (F.col("batch") <= upto)))

    def compact(self, upto: int) -> None:
        """Adds the batches up to a number for good; earlier numbers than were compacted before change nothing."""
        if upto > self._counted(self._rows()):
            self._write(self._live(upto), "base", upto)

    def read(self) -> DataFrame:
        """A row for each key."""
        return self._merged(self._live())

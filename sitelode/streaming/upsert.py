"""A table of one row per key that micro-batches are merged into, with exactly-once effect."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class KeyedTable:
    """Parquet below ``path``, one row per ``key``, in buckets of keys.

    ``merge`` takes rows of ``schema``, grouped as its second argument says, to one per key; merging what it gave with
    more rows has to be the same as merging all at once. A batch rewrites only the buckets it has keys of, below a
    folder of its own. A small manifest, written last and in one file, then says which folder holds each bucket: readers see
    a batch as a whole or not at all. A batch whose number a manifest has is not merged again, and one that broke off is
    written anew, so that a retried batch changes nothing.
    """

    path: str
    schema: T.StructType
    key: str
    merge: Callable[[DataFrame, list[str]], DataFrame]
    buckets: int = 16

    def create(self, spark: SparkSession) -> KeyedTable:
        """An empty table."""
        self._say(spark, -1, {})
        return self

    def _say(self, spark: SparkSession, batch_id: int, folders: dict[int, str]) -> None:
        rows = spark.createDataFrame(sorted(folders.items()), "bucket int, folder string").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.path}/manifests/batch={batch_id}")

    def _folders(self, spark: SparkSession) -> tuple[int, dict[int, str]]:
        """The last batch merged, and the folder of each bucket that has rows: at most ``buckets`` rows."""
        said = spark.read.schema("bucket int, folder string, batch long").parquet(f"{self.path}/manifests")
        last = said.agg(F.max("batch")).first()[0]
        return (-1, {}) if last is None else (last, {r["bucket"]: r["folder"] for r in said.where(F.col("batch") == last).collect()})

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Merges a batch; to be given to ``foreachBatch``."""
        spark = batch.sparkSession
        last, folders = self._folders(spark)
        if batch_id <= last:
            return
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        # What is new is merged first, so that a key's repeats end before the shuffle.
        fresh = self.merge(batch.select(*self.schema.names).withColumn("bucket", bucket), ["bucket", self.key]).persist()
        try:
            touched = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}
            rows = fresh
            if held := [folders[b] for b in sorted(touched) if b in folders]:
                rows = self.merge(self._read(spark, held).withColumn("bucket", bucket).unionByName(fresh), ["bucket", self.key])
            home = f"{self.path}/batches/{batch_id}"
            # Keys are spread over the buckets by hash, one row each.
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(home)
        finally:
            fresh.unpersist()
        self._say(spark, batch_id, folders | {b: f"{home}/bucket={b}" for b in touched})

    def _read(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        return spark.read.schema(self.schema).parquet(*folders)

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as the last whole batch left it."""
        folders = sorted(self._folders(spark)[1].values())
        return self._read(spark, folders) if folders else spark.createDataFrame([], self.schema)


def run_batches(stream: DataFrame, folder: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over all data there is, each batch through ``sink``."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()

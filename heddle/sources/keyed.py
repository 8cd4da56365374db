"""Tables with one row a key that batches change in place: hash buckets, of which a batch rewrites only those it touches, in versions by epoch.

A row lies under ``_bucket=<hash of its key>/_epoch=<batch that wrote it>``; a bucket's rows are those of its newest epoch. A batch reads the buckets that its keys fall in, as they were
before its own epoch, and writes their next version by dynamic partition overwrite. So a batch that runs again, or was cut off halfway and is replayed, gives the same table; readers
see each bucket before or after a batch, never in between; buckets without a changed key keep their files. A version holds a mark, so that a bucket may become empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

Change = Callable[[DataFrame, DataFrame], DataFrame]
_EXTRA = [T.StructField("_mark", T.BooleanType()), T.StructField("_bucket", T.IntegerType()), T.StructField("_epoch", T.LongType())]


@dataclass(frozen=True)
class KeyedTable:
    """``buckets`` is fixed for the life of a table: about as many as make a bucket a fraction of a file block, and more than a batch has tasks."""

    spark: SparkSession
    path: str
    key: str
    schema: T.StructType
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _all(self) -> DataFrame:
        full = T.StructType([*self.schema.fields, *_EXTRA])
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(self.path)

    def _versions(self, before: int | None) -> DataFrame:
        """``(_bucket, _epoch)`` of the newest versions: a row a bucket, from the marks."""
        marks = self._all().where("_mark")
        if before is not None:
            marks = marks.where(F.col("_epoch") < before)
        return marks.groupBy("_bucket").agg(F.max("_epoch").alias("_epoch"))

    def read(self, before: int | None = None) -> DataFrame:
        """The rows, or those before an epoch."""
        newest = F.broadcast(self._versions(before))  # a row a bucket
        return self._all().where(~F.col("_mark")).join(newest, ["_bucket", "_epoch"], "left_semi").select(self.schema.fieldNames())

    def change(self, epoch: int, batch: DataFrame, make: Change) -> None:
        """Makes the table's next version: ``make(old rows, batch)`` gives the new rows of the buckets that the batch's keys fall in, and of no others."""
        batch = batch.where(F.col(self.key).isNotNull()).persist()
        try:
            touched = sorted(r[0] for r in batch.select(self._bucket()).distinct().collect())  # bucket numbers
            if not touched:
                return
            newest = F.broadcast(self._versions(epoch).where(F.col("_bucket").isin(touched)))
            old = self._all().where(F.col("_bucket").isin(touched) & ~F.col("_mark")).join(newest, ["_bucket", "_epoch"], "left_semi").select(self.schema.fieldNames())
            rows = make(old, batch).select(self.schema.fieldNames()).withColumns({"_mark": F.lit(False), "_bucket": self._bucket()})
            marks = self.spark.createDataFrame([(b,) for b in touched], "_bucket int").withColumn("_mark", F.lit(True))
            both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_epoch", F.lit(epoch).cast("long"))
            both.repartition(len(touched), "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_epoch").parquet(self.path)
        finally:
            batch.unpersist()

    def vacuum(self) -> int:
        """Deletes versions that newer ones have replaced, once no reader or replay needs them; returns how many."""
        old = self._all().where("_mark").select("_bucket", "_epoch").join(F.broadcast(self._versions(None).withColumnRenamed("_epoch", "_new")), "_bucket").where("_epoch < _new")
        gone = 0
        for r in old.distinct().toLocalIterator():
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_bucket={r['_bucket']}/_epoch={r['_epoch']}")
            gone += bool(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True))
        return gone

    def follow(self, stream: DataFrame, make: Change, checkpoint: str) -> StreamingQuery:
        """Applies a stream's batches, each once however often it is replayed; stops when the input is used up."""
        return stream.writeStream.foreachBatch(lambda batch, n: self.change(n + 1, batch, make)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def put_latest(key: str, *order: Column) -> Change:
    """The last row of each key in the batch replaces the stored one."""
    from .sinks import latest, upsert

    return lambda old, batch: upsert(old, latest(batch, key, *order), key)


def put_responses(now: Column) -> Change:
    """Stores responses; a stored key keeps its hit count. Of several responses for a key the least counts."""
    from .sinks import cache_put

    return lambda old, batch: cache_put(old, batch.groupBy("cache_key").agg(F.min(F.struct("response", "call_type", "lang")).alias("r")).select("cache_key", "r.response", "r.call_type", "r.lang"), now)


def add_hits(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Raises hit counts by the batch's hits."""
    from .sinks import with_hits

    return with_hits(old, batch)


def drop_keys(key: str) -> Change:
    from .sinks import without_keys

    return lambda old, batch: without_keys(old, batch.select(key), key)

"""What earlier runs have done: a table of digests in hash buckets, which each run joins where it lies.

The table is stored in buckets of its digest, so a run shuffles only its own digests, to as many partitions as the table has buckets; the stored side, which grows from run
to run, is read bucket by bucket without an exchange. A run's own repeats are settled first (the first id of a digest stays), then what the table knows falls out, and what is left is
appended when its work is done.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SeenTable:
    """``name`` in the session's catalogue; ``path`` puts its files into a shared folder of choice, where a later session's catalogue finds them. ``buckets`` is fixed for the life of the table."""

    spark: SparkSession
    name: str
    buckets: int = 64
    path: str | None = None

    def _stored(self) -> DataFrame | None:
        if not self.spark.catalog.tableExists(self.name):
            if self.path is None:
                return None
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
                return None
            self.spark.sql(f"CREATE TABLE {self.name} (digest STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return self.spark.table(self.name)

    def fresh(self, rows: DataFrame, digest: Column, *order: str) -> DataFrame:
        """``(digest, <order>)``: of each digest that no run has remembered, the first row of this one. Null digests are never new."""
        own = rows.select(digest.alias("digest"), *order).where("digest is not null")
        first = own.groupBy("digest").agg(F.min(F.struct(*order)).alias("_first")).select("digest", *(F.col(f"_first.{c}").alias(c) for c in order))
        old = self._stored()
        if old is None:
            return first
        # A hint, as a size-based broadcast of the batch would make Spark read all buckets anyway, and one of the table would grow with it.
        return first.repartition(self.buckets, "digest").hint("shuffle_merge").join(old.select("digest"), "digest", "left_anti")

    def remember(self, digests: DataFrame) -> None:
        """Adds digests; several times the same ones do no harm."""
        self._stored()
        rows = digests.select("digest").repartition(self.buckets, "digest").write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        (rows.option("path", self.path) if self.path else rows).saveAsTable(self.name)

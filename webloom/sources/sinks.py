"""Table sinks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_counts(counts: DataFrame, path: str) -> None:
    """Counts as CSV with a header."""
    counts.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # one small row set


def write_table(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def overwrite_partitions(rows: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions that ``rows`` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def counts(**tables: DataFrame) -> DataFrame:
    """A row with the number of rows of each table."""
    found = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias(name))
        found = one if found is None else found.crossJoin(one)  # one row each
    return found


@dataclass(frozen=True)
class KeyedTable:
    """A table with one row a key, which batches of a stream change, each exactly once however often it is given.

    Rows are dealt over buckets by their keys. A batch writes only the buckets that its keys
    fall in, to folders of its own, and then a manifest of where each bucket stands; a reader
    takes the newest manifest. A batch that is given again starts from the manifest before
    it and overwrites its own folders, so it changes nothing, also where it was cut short.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    #: Columns by which the last of a key's rows in a batch counts, and whether a row that is there stays.
    order: tuple[str, ...]
    keep_existing: bool = False
    buckets: int = 64

    def _standing(self, before: int | None = None) -> dict[int, list[int]]:
        """For each batch the buckets that stand in its folder, by the newest manifest."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return {}
        rows = self.spark.read.schema("bucket int, at long, batch long").parquet(f"{self.path}/manifest")
        rows = rows if before is None else rows.where(F.col("batch") < before)
        newest = rows.agg(F.max("batch")).first()[0]
        found: dict[int, list[int]] = {}
        for r in rows.where(F.col("batch") == newest).collect() if newest is not None else []:  # a row a bucket
            found.setdefault(r["at"], []).append(r["bucket"])
        return found

    def _read(self, standing: dict[int, list[int]]) -> DataFrame:
        parts = [self.spark.read.schema(f"{self.schema}, bucket int").option("basePath", f"{self.path}/data/batch={at}").parquet(f"{self.path}/data/batch={at}").where(F.col("bucket").isin(own)) for at, own in standing.items() if own]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{self.schema}, bucket int")

    def rows(self) -> DataFrame:
        return self._read(self._standing()).drop("bucket")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Bring in the rows of a batch; to be given to ``foreachBatch``."""
        names = [c for c in self.rows().columns]
        fields = [c for c in names if c not in self.keys]
        pick = F.min_by if self.keep_existing else F.max_by
        last = batch.groupBy(*self.keys).agg(pick(F.struct(*fields), F.struct(*self.order)).alias("r")).select(*self.keys, "r.*")
        dealt = last.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).persist()
        touched = [r.bucket for r in dealt.select("bucket").distinct().collect()]
        standing = self._standing(batch_id)
        there = self._read({at: [b for b in own if b in touched] for at, own in standing.items()}).select(*names, "bucket")
        keys = list(self.keys)
        if self.keep_existing:
            merged = there.unionByName(dealt.join(there.select(*keys), keys, "left_anti").select(*names, "bucket"))
        else:
            merged = there.join(dealt.select(*keys), keys, "left_anti").unionByName(dealt.select(*names, "bucket"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch_id}")
        places = {b: at for at, own in standing.items() for b in own} | dict.fromkeys(touched, batch_id)
        manifest = self.spark.createDataFrame(sorted(places.items()), "bucket int, at long")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch_id}")
        dealt.unpersist()

    def run(self, stream: DataFrame) -> DataFrame:
        """The table after all rows that a stream has now."""
        running = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start()
        try:
            running.awaitTermination()
        finally:
            running.stop()
        return self.rows()

"""A store of documents that is replaced bucket by bucket.

The rows of a table lie in a bucket by a CRC-32 of their key; every bucket is one
folder. A manifest says which folder holds each bucket now: rows (version,
table, bucket, folder) of which the last version of a bucket counts. A commit
writes the buckets it touches to new folders and then adds its manifest rows
as one file, which appears as a whole or not at all. Until then readers see the
old state, and a commit that fails leaves it. Folders of untouched buckets are
never opened. One writer at a time; folders that no manifest row names any
more are left to the owner of the storage.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, name string, bucket int, folder string"


@dataclass(frozen=True)
class Store:
    """``spread`` tasks write a bucket, by a hash of key and part; so a hot key does not fall to one."""

    path: str
    key: str
    buckets: int
    spread: int = 8

    def bucket(self) -> Column:
        return (F.crc32(F.col(self.key).cast("string").cast("binary")) % self.buckets).cast("int")

    def bucket_of(self, key: object) -> int:
        return zlib.crc32(str(key).encode()) % self.buckets

    def _manifest(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], MANIFEST)

    def version(self, spark: SparkSession) -> int:
        """The number of the last commit, 0 before the first."""
        return self._manifest(spark).agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]

    def folders(self, spark: SparkSession, name: str) -> dict[int, str]:
        """The folder of every bucket that has rows; as many entries as buckets at most."""
        last = F.max(F.struct("version", "folder")).alias("last")
        rows = self._manifest(spark).where(F.col("name") == name).groupBy("bucket").agg(last).where("last.folder IS NOT NULL")
        return {r["bucket"]: r["last"]["folder"] for r in rows.collect()}

    def read(self, spark: SparkSession, name: str, keys: Iterable[object] | None = None) -> DataFrame | None:
        """The rows of a table, or of some keys from their buckets alone; None if there is nothing to read."""
        folders = self.folders(spark, name)
        if keys is None:
            return self._of(spark, folders, folders)
        wanted = list(keys)
        rows = self._of(spark, folders, {self.bucket_of(k) for k in wanted})
        return None if rows is None else rows.where(F.col(self.key).isin(wanted))

    def _of(self, spark: SparkSession, folders: Mapping[int, str], buckets: Iterable[int]) -> DataFrame | None:
        paths = [f"{self.path}/{folders[b]}" for b in sorted(buckets) if b in folders]
        return spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def commit(self, tables: Mapping[str, DataFrame], keys: DataFrame) -> int:
        """Put the rows of ``tables`` in place of all stored rows of ``keys``; returns the new version.

        ``keys`` names every key that is written anew or goes away, in its first
        column; rows of other keys in ``tables`` are an error.
        """
        spark = keys.sparkSession
        own = keys.select(F.col(keys.columns[0]).alias(self.key)).distinct()
        touched = sorted(r["bucket"] for r in own.select(self.bucket().alias("bucket")).distinct().collect())
        version = self.version(spark) + 1
        rows = []
        for name, fresh in tables.items():
            held = self._of(spark, self.folders(spark, name), touched)
            whole = fresh if held is None else held.join(own, self.key, "left_anti").unionByName(fresh, allowMissingColumns=True)
            folder = f"{name}/{version}-{uuid.uuid4().hex}"
            salt = F.pmod(F.xxhash64(*[c for c in (self.key, "part") if c in whole.columns]), F.lit(self.spread))
            placed = whole.withColumn("bucket", self.bucket())
            placed.repartition(F.col("bucket"), salt).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            written = spark.read.schema("bucket int").parquet(f"{self.path}/{folder}").select("bucket").distinct()
            filled = {r["bucket"] for r in written.collect()}
            if not filled <= set(touched):
                raise ValueError(f"{name} has rows whose {self.key} is not among the keys of the commit")
            rows += [(version, name, b, f"{folder}/bucket={b}" if b in filled else None) for b in touched]
        # One file: the commit is there once it is.
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return version

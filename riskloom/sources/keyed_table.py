"""A Parquet table with a key that takes upserts without being rewritten.

Rows are dealt to buckets by the hash of their key; a bucket is a folder of one version. An upsert rewrites the buckets that
its keys fall into, in folders of the next version, and then writes that version's manifest: the folder of every bucket. A
manifest counts once Spark has marked it complete, so a reader sees the table before or after an upsert and never between, and
a run that dies leaves folders nobody names. Two writers of one version: the second fails.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.ordered import latest_per_key

_MANIFEST = "bucket int, folder string"


class KeyedTable:
    """buckets: fixed when the table is made; a table of n GB does well with some 10 n of them."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], version: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.version, self.buckets = list(keys), list(version), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _latest(self) -> int | None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        fs = top.getFileSystem(conf)
        if not fs.exists(top):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        whole = [int(n) for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{n}/_SUCCESS"))]
        return max(whole, default=None)

    def folders(self, version: int | None = None) -> dict[int, str]:
        """Folder of each bucket that has rows, of the latest version or the one given."""
        version = self._latest() if version is None else version
        if version is None:
            return {}
        # One row a bucket.
        return {r["bucket"]: r["folder"] for r in self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifests/{version}").collect()}

    def _read(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(list(self.folders(version).values()))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of `keys` (the key columns): only their buckets are read."""
        touched = self._touched(keys)
        return self._read([f for b, f in self.folders().items() if b in touched]).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()}

    def upsert(self, changes: DataFrame, gone: Column | None = None) -> int:
        """Newest row per key of the table and `changes` (equal versions: the change); keys whose newest row is `gone` leave.

        Returns the new version. Changes may hold a key many times; those of one key are combined before they are shuffled.
        """
        before, version = self.folders(), self._latest()
        target = 0 if version is None else version + 1
        names = self.spark.createDataFrame([], self.schema).columns
        newest = latest_per_key(changes.select(*names), self.keys, self.version)
        touched = self._touched(newest)
        old = self._read([f for b, f in before.items() if b in touched])
        both = old.withColumn("_new", F.lit(0)).unionByName(newest.withColumn("_new", F.lit(1)))
        kept = latest_per_key(both, self.keys, [*self.version, "_new"]).drop("_new")
        kept = kept.where(~F.coalesce(gone, F.lit(False))) if gone is not None else kept
        folder = f"data/{target}-{self.spark.sparkContext.applicationId}"
        marked = kept.withColumn("_bucket", self._bucket())
        # Every touched bucket is one task's work and one folder.
        marked.repartition(max(1, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        left = {r["_bucket"] for r in self.spark.read.parquet(f"{self.path}/{folder}").select("_bucket").distinct().collect()} if touched and not kept.isEmpty() else set()
        after = {b: f for b, f in before.items() if b not in touched} | {b: f"{folder}/_bucket={b}" for b in left}
        listed = self.spark.createDataFrame(sorted(after.items()), _MANIFEST).coalesce(1)
        try:
            listed.write.mode("errorifexists").json(f"{self.path}/manifests/{target}")
        except AnalysisException as problem:
            raise RuntimeError(f"version {target} was written by another run") from problem
        return target

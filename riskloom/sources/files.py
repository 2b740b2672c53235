"""File scans and writers with explicit schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import written


def _there(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def read_json_arrays(spark: SparkSession, paths: Sequence[str], schema: str, optional: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Records of files that each hold one JSON array, and the broken files: (records with source, (source, content)).

    `optional` paths that are not there are passed over; a missing one of `paths` is an error. A file that is no JSON counts as
    broken as a whole and gives no record.
    """
    wanted = [*paths, *(p for p in optional if _there(spark, p))]
    fields = T.StructType(spark.createDataFrame([], schema).schema.fields + [T.StructField("_broken", T.StringType())])
    rows = spark.read.schema(fields).option("multiLine", True).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_broken").json(wanted).withColumn("source", F.input_file_name())
    # Parsed once for both results.
    rows = written(rows, "json-arrays")
    return rows.where("_broken is null").drop("_broken"), rows.where("_broken is not null").select("source", F.col("_broken").alias("content"))


def write_json_arrays(df: DataFrame, path: str) -> None:
    """One array a task, written record by record: no task holds its array."""
    def run(batches):
        first = True
        for batch in batches:
            lines = [("[" if first and i == 0 else ",") + v.as_py() for i, v in enumerate(batch.column(0))]
            first = first and not lines
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"], pa.string())], ["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(run, "value string").write.text(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON record per line; blank lines give no row."""
    return spark.read.schema(schema).json(path)


def read_incremental(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """File stream that takes a bounded number of new files per batch."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))


def canonical(
    df: DataFrame, aliases: Mapping[str, Sequence[str]], defaults: Mapping[str, object] | None = None,
    nested_flags: Sequence[str] = (), split: str | None = None, holder: str = "risk_indicators",
) -> DataFrame:
    """One name per field: the first alias with a value wins, then the default; flags are lifted out."""
    defaults = dict(defaults or {})
    present = set(df.columns)
    used = {a for names in aliases.values() for a in names}
    out = [F.col(c) for c in df.columns if c not in used and c not in aliases and c != holder]
    for name, names in aliases.items():
        values = [F.col(a) for a in names if a in present]
        if name in defaults:
            values.append(F.lit(defaults[name]))
        out.append((F.coalesce(*values) if values else F.lit(None).cast(T.StringType())).alias(name))
    out += [F.coalesce(F.col(f"{holder}.{f}"), F.lit(False)).alias(f) for f in nested_flags]
    if split is not None:
        out.append(F.lit(split).alias("split"))
    return df.select(*out)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def append_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)

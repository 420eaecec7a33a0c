"""Backups of a record table: a copy, a manifest with checksums, verification, restore."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import verify_chain


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the table's files, with names as they are below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    root = F.lit(path.rstrip("/").split(":", 1)[-1].lstrip("/"))
    name = F.expr("regexp_replace(path, '^[a-z0-9]+:/+', '')")
    return files.select(F.substring(name, F.char_length(root) + 2, F.char_length(name)).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def backup(spark: SparkSession, table: str, to: str) -> DataFrame:
    """Copy the records of ``table`` to ``to``/data and write ``to``/manifest; returns the manifest."""
    spark.read.parquet(table).write.mode("overwrite").parquet(f"{to}/data")
    manifest(spark, f"{to}/data").write.mode("overwrite").parquet(f"{to}/manifest")
    return spark.read.parquet(f"{to}/manifest")


def verify_backup(spark: SparkSession, at: str) -> DataFrame:
    """(file, problem): files that are missing, new or changed; none if the backup is whole."""
    have, want = manifest(spark, f"{at}/data"), spark.read.parquet(f"{at}/manifest")
    both = want.withColumnRenamed("sha256", "want").select("file", "want").join(have.select("file", "sha256"), "file", "full")
    problem = F.when(F.col("want").isNull(), "new").when(F.col("sha256").isNull(), "missing").when(F.col("want") != F.col("sha256"), "changed")
    return both.select("file", problem.alias("problem")).where("problem IS NOT NULL")


def restore(spark: SparkSession, at: str, to: str) -> DataFrame:
    """Write the backup's records to ``to`` if the backup is whole; returns the streams' sequence check."""
    if not verify_backup(spark, at).isEmpty():
        raise ValueError("the backup is damaged")
    spark.read.parquet(f"{at}/data").write.mode("overwrite").parquet(to)
    return verify_chain(spark.read.parquet(to))

"""Sinks: exports, snapshots with manifests, and writes that replace what they rewrite."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def chunks_json(chunks: DataFrame, path: str) -> None:
    """K9."""
    chunks.write.mode("overwrite").json(path)


def chunks_csv(chunks: DataFrame, path: str) -> None:
    """K9: RFC 4180, with a head in each part."""
    chunks.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def chunks_markdown(chunks: DataFrame) -> DataFrame:
    """K9: (doc_id, markdown), a heading a chunk; a document's chunks are few enough for one value."""
    part = F.concat(F.lit("## #"), F.col("seq").cast("string"), F.lit("\n\n"), F.col("text"))
    return chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", part.alias("part")))).alias("parts")).select("doc_id", F.array_join("parts.part", "\n\n").alias("markdown"))


def replace_partitions(chunks: DataFrame, path: str, by: str = "doc_bucket") -> None:
    """K5: the partitions that chunks has rows for are replaced, others stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def create_collection(spark: SparkSession, name: str, dim: int) -> None:
    """K1: a table of points, if there is none; its dimension is a property."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` (id STRING, dense ARRAY<FLOAT>, sparse MAP<INT, DOUBLE>, payload STRING) USING parquet TBLPROPERTIES ('dim' = '{int(dim)}')")


def backup(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Every table as Parquet, and a manifest of counts."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    counts = [(name, spark.read.parquet(f"{path}/{name}").count()) for name in tables]
    manifest = spark.createDataFrame(counts, "name string, n long")
    manifest.write.mode("overwrite").json(f"{path}/_manifest.json")
    return manifest


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a manifest, if their counts still hold."""
    out = {}
    for r in spark.read.schema("name string, n long").json(f"{path}/_manifest.json").collect():
        out[r.name] = spark.read.parquet(f"{path}/{r.name}")
        if out[r.name].count() != r.n:
            raise ValueError(f"{r.name} has other rows than its manifest says")
    return out


def prometheus(metrics: DataFrame, prefix: str = "kb") -> DataFrame:
    """Metrics (name, labels map, value) as exposition lines."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.format_string('%s="%s"', e["key"], e["value"])), ",")
    return metrics.select(F.concat(F.lit(f"{prefix}_"), F.col("name"), F.when(F.size("labels") > 0, F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("line"))


def manifest_text(manifest: DataFrame) -> str:
    return json.dumps({r.name: r.n for r in manifest.collect()}, sort_keys=True)

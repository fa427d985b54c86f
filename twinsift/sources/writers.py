"""Sinks. Every writer returns nothing; read the result back with the readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM_PRIVATE = ("tech_sign", "tech_signs")


def _as_text(df: DataFrame) -> DataFrame:
    """All columns as text with missing values as empty strings, as CSV consumers expect."""
    return df.select(*[
        F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def enriched_columns(original: Sequence[str], new: Sequence[str]) -> list[str]:
    """Original columns in order, then the new ones that were not there before."""
    return list(original) + [c for c in new if c not in original]


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None,
              sep: str = ",") -> None:
    (_as_text(df.select(*[f"`{c}`" for c in columns]) if columns else df)
     .write.option("header", "true").option("sep", sep).option("emptyValue", "")
     .option("escape", '"').csv(path))


def write_enriched(df: DataFrame, original: Sequence[str], new: Sequence[str], path: str) -> None:
    write_csv(df, path, enriched_columns(original, new))


def write_items(items: DataFrame, path: str) -> None:
    """Items as JSON lines, without the columns that would give the answer away."""
    items.drop(*ITEM_PRIVATE).write.json(path)


def write_manifest(manifest: DataFrame, json_path: str, csv_path: str,
                   columns: Sequence[str]) -> None:
    """The whole manifest as JSON lines and a flat column subset as CSV."""
    manifest.write.json(json_path)
    write_csv(manifest, csv_path, columns)


def write_registry(registry: DataFrame, path: str) -> None:
    """(Crop, Disease, n_images) sorted by crop and disease over the output files."""
    ordered = registry.select(F.col("crop").alias("Crop"), F.col("disease").alias("Disease"),
                              "n_images").orderBy("Crop", "Disease")
    write_csv(ordered, path)


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace only the partitions present in `df`."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(path))

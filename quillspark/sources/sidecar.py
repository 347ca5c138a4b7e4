"""Derived relations kept beside a corpus (frequencies, terms, edges, factors): written whole, checked when they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SidecarError(ValueError):
    """A stored relation is of another kind, of another width, or not whole."""


def _digest(df: DataFrame) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")]


def save(df: DataFrame, path: str, kind: str, total: float = 0.0) -> None:
    """Replace what is stored at path by df; its one-row description is written last, so that half a write is never read."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    rows.agg(*_digest(rows)).select(F.lit(kind).alias("kind"), F.lit(float(total)).alias("total"), "rows", "digest").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, float]:
    """(the relation, its total); raises where kind, number of rows or digest differ from the description."""
    about = spark.read.parquet(f"{path}/about").first()
    if about is None or about["kind"] != kind:
        raise SidecarError(f"{path} holds {about['kind'] if about else 'nothing'}, not {kind}")
    rows = spark.read.parquet(f"{path}/rows")
    if tuple(rows.agg(*_digest(rows)).first()) != (about["rows"], about["digest"]):
        raise SidecarError(f"{path} is not whole")
    return rows, about["total"]


def of_one_width(vectors: DataFrame, column: str = "v") -> DataFrame:
    """vectors, unless their widths are mixed: two builds can't share a space."""
    widths = [r[0] for r in vectors.select(F.size(column)).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise SidecarError(f"widths are mixed: {sorted(widths)}")
    return vectors

"""Table access, shape assertions and the binding of roles (works, tags, readers) to physical tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns a relation must have before an operator may run on it.
SHAPES = {
    "works": {"id", "title", "authors", "word_count", "rating", "kudos", "hits", "bookmarks", "complete", "update_date", "language"},
    "work_tags": {"work_id", "tag", "tag_type"},
    "interactions": {"user_id", "work_id"},
}


class ShapeError(ValueError):
    """A relation lacks required columns."""


def assert_shape(df: DataFrame, role: str) -> DataFrame:
    missing = SHAPES[role] - set(df.columns)
    if missing:
        raise ShapeError(f"{role} lacks {sorted(missing)}")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_table(spark: SparkSession, sf_dir: str, name: str) -> bool:
    """Probe for an optional table through Spark's own file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


@dataclass(frozen=True)
class Roles:
    """The relations that operators work on, whatever tables stand behind them."""

    works: DataFrame
    work_tags: DataFrame
    interactions: DataFrame


def language_of(n: Column) -> Column:
    """Five in eight English, two French, one German: a fixed cycle."""
    return F.when(n % 8 < 5, "English").when(n % 8 < 7, "French").otherwise("German")


def catalog(spark: SparkSession, sf_dir: str) -> Roles:
    """Parts as works, words of names, brands, types and sizes as tags, customers as readers of what they ordered."""
    part, lineitem, orders = (table(spark, sf_dir, t) for t in ("part", "lineitem", "orders"))
    sold = lineitem.select("l_orderkey", "l_partkey", "l_quantity").join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    stats = sold.groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"), F.countDistinct("o_custkey").alias("b"), F.max("o_orderdate").alias("d"))
    works = part.join(stats, part["p_partkey"] == stats["l_partkey"], "left").select(
        F.col("p_partkey").cast("long").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("authors"),
        (F.col("p_size").cast("long") * 1000).alias("word_count"),
        F.col("p_type").alias("rating"),
        F.coalesce("q", F.lit(0)).cast("long").alias("kudos"),
        F.coalesce("n", F.lit(0)).cast("long").alias("hits"),
        F.col("b").alias("bookmarks"),
        (F.col("p_size") % 3 != 0).alias("complete"),
        F.to_date("d").alias("update_date"),
        language_of(F.col("p_size")).alias("language"),
    )
    tag = lambda name, kind: F.struct(name.alias("tag"), F.lit(kind).alias("tag_type"))
    words = F.transform(F.split("p_name", " "), lambda w: tag(w, "name"))
    others = F.array(tag(F.col("p_brand"), "brand"), tag(F.col("p_type"), "type"), tag(F.concat(F.lit("size "), F.col("p_size").cast("string")), "size"))
    tags = part.select(F.col("p_partkey").cast("long").alias("work_id"), F.explode(F.array_distinct(F.concat(words, others))).alias("t")).select("work_id", "t.tag", "t.tag_type")
    return Roles(works, tags, sold.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").cast("long").alias("work_id")))

"""Staging tables and connected components shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; one of our own only where that is unset and all runs in this process (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors.

    Shuffle files of the jobs that made it are dropped as soon as nothing refers to them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a staged table whose readers are done; one still listed is deleted at exit."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        for k, (spark, known) in enumerate(_written):
            if path.endswith(known.rsplit("/", 1)[1]):
                _delete(spark, known)
                del _written[k]
                break


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished phases, whose frames are out of scope."""
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone: the folder's owner cleans it
            return


atexit.register(_clean)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list by alternating large-star and small-star steps.

    Returns (node, root): one row for every node on an edge whose root differs from itself; root is the smallest node
    reachable. Self loops, repeated and null edges have no effect. Every step is a min-aggregate with map-side combine and
    an equi-join (splittable where a hub holds many edges); each round is written to the shared folder.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = stage(e, "edges")
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        n = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if tuple(n) == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(n)

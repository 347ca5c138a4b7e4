"""The registered queries of this subpackage and their SQL; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import chunks, secrets
from quillspark.llm.chunks import substring_dedup
from quillspark.llm.decontaminate import leaks
from quillspark.llm.hnsw import embedding_links
from quillspark.llm.licenses import license_scan
from quillspark.llm.minhash import near_duplicates
from quillspark.llm.mixing import mix_sources
from quillspark.llm.quality import quality_scores
from quillspark.llm.suffixes import suffix_dedup
from quillspark.llm.suffixtree import suffix_tree_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(_table(spark, sf_dir, "embeddings"), 0.93).withColumnRenamed("id", "vec_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document that loses a passage, with its removed spans and the documents that keep them."""
    return substring_dedup(_table(spark, sf_dir, "documents"), shortest=chunks.SHORTEST, stretch=chunks.STRETCH).where("n_spans > 0").withColumnRenamed("id", "doc_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and test item that it leaks."""
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85).withColumnRenamed("id", "doc_id")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(_table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "crf")
    counts = [secrets.count_of(spans, k).alias(f"n_{k}") for k in secrets.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(spans).alias("spans"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(_table(spark, sf_dir, "documents"), 100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_embedding_near_dedup, op2_substring_dedup, op3_license_scan, op4_benchmark_decontamination, op5_minhash_near_dedup,
        op6_secret_scan, op7_quality_classifier, op8_source_mixing, op9_suffix_tree_scoring, op10_suffix_array_dedup,
    )}


#: Components of links(a, b) over nodes(id): every node's smallest reachable id.
_REACH = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, r) AS (SELECT a, a FROM both_ways UNION SELECT reach.id, b FROM reach JOIN both_ways ON reach.r = both_ways.a),
roots AS (SELECT id, min(r) AS root FROM reach GROUP BY 1)"""

_OP1 = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
links AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.label = q.label AND p.id < q.id WHERE p.n > 0 AND q.n > 0 AND list_dot_product(p.x, q.x) / (p.n * q.n) >= 0.93),
{_REACH}, per AS (SELECT a AS id, count(*) AS c FROM both_ways GROUP BY 1)
SELECT v.id AS vec_id, coalesce(c, 0)::BIGINT AS n_links, coalesce(root, v.id) AS component_id, v.id = coalesce(root, v.id) AS kept FROM v LEFT JOIN per ON per.id = v.id LEFT JOIN roots ON roots.id = v.id"""

_OP5 = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || '  ' || len(w)] ELSE [] END) AS g FROM w),
z AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT p.id AS a, q.id AS b FROM s p JOIN s q ON p.g = q.g AND p.id < q.id JOIN z x ON x.id = p.id JOIN z y ON y.id = q.id GROUP BY p.id, q.id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
{_REACH}
SELECT w.id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, w.id) AS component_id, w.id = coalesce(root, w.id) AS kept FROM w LEFT JOIN z ON z.id = w.id LEFT JOIN roots ON roots.id = w.id"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries whose rows it can express; the others are tested against plain Python."""
    return {"op1_embedding_near_dedup": _OP1, "op5_minhash_near_dedup": _OP5}

"""Queries over vectors, families, factors, pages and snapshots, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators import corpus as op
from quillspark.operators import learning as ml
from quillspark.plans.corpus import vectors
from quillspark.plans.ranking import TV, tag_vectors
from quillspark.plans.registry import query
from quillspark.sources import html as ht
from quillspark.sources.tables import catalog, table


@query(
    TV + """, s AS (SELECT work_id, p, sum(x / sqrt(df)) AS x FROM (SELECT work_id, df, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM carried JOIN tv USING (tag) JOIN df USING (tag) WHERE work_id IN (SELECT work_id FROM carried JOIN tv USING (tag) GROUP BY 1 HAVING count(*) >= 3)) GROUP BY 1, 2),
    n AS (SELECT work_id, sqrt(sum(x * x)) AS n FROM s GROUP BY 1) SELECT work_id, round(max(x / n), 5) AS top, round(sum(x / n), 4) AS total, count(*) AS dims FROM s JOIN n USING (work_id) GROUP BY 1""",
    "carried df",
)
def work_vectors(spark, d):
    r = catalog(spark, d)
    v = ml.work_vectors(r.work_tags, tag_vectors(spark, d, r.work_tags))
    return v.select("work_id", F.round(F.array_max("v"), 5).alias("top"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("v").cast("long").alias("dims"))


@query()
def kmeans_families(spark, d):
    return ml.families(vectors(spark, d), 10)


@query(
    """WITH p AS (SELECT label AS a, vec_id % 10 AS b FROM embeddings), c AS (SELECT sum(n * (n - 1) / 2) AS both_, sum(n) AS t FROM (SELECT count(*) AS n FROM p GROUP BY a, b)),
    x AS (SELECT sum(n * (n - 1) / 2) AS ra FROM (SELECT count(*) AS n FROM p GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS rb FROM (SELECT count(*) AS n FROM p GROUP BY b))
    SELECT round((both_ - ra * rb / (t * (t - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (t * (t - 1) / 2)), 6) AS ari, t::BIGINT AS n FROM c, x, y"""
)
def adjusted_rand(spark, d):
    p = vectors(spark, d).select(F.col("label").alias("a"), (F.col("id") % 10).alias("b"))
    return ml.adjusted_rand(p, "a", "b").withColumn("ari", F.round("ari", 6))


@query("SELECT label, max(n) AS largest, sum(n)::BIGINT AS size, round(max(n) / sum(n), 6) AS purity FROM (SELECT label, vec_id % 7 AS c, count(*) AS n FROM embeddings GROUP BY 1, 2) GROUP BY 1")
def purity(spark, d):
    p = vectors(spark, d).select("label", (F.col("id") % 7).alias("c"))
    return ml.purity(p, "label", "c").withColumn("purity", F.round("purity", 6))


@query(
    """, m AS (SELECT id AS work_id, id % 6 AS family FROM works), c AS (SELECT family, tag FROM carried JOIN m USING (work_id)), z AS (SELECT family, count(*) AS size FROM m GROUP BY 1), f AS (SELECT tag, count(*) AS df FROM c GROUP BY 1),
    h AS (SELECT family, tag, count(*) AS here FROM c GROUP BY 1, 2 HAVING count(*) >= 2), w AS (SELECT family, tag, here, round((here / size) * ((here / size) / (f.df / n)), 9) AS worth FROM h JOIN z USING (family) JOIN f USING (tag), total)
    SELECT family, tag, here, round(worth, 6) AS worth, rank FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY worth DESC, tag) AS rank FROM w) WHERE rank <= 3""",
    "works carried total",
)
def theme_labels(spark, d):
    r = catalog(spark, d)
    m = r.works.select(F.col("id").alias("work_id"), (F.col("id") % 6).alias("family"))
    return ml.theme_labels(m, r.work_tags).withColumn("worth", F.round("worth", 6))


@query(
    """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i = 1 THEN x * 1.5 ELSE x END) AS w FROM embeddings)
    SELECT count(*) AS shared, round(avg(list_cosine_similarity(v, w)), 5) AS cosine, round(avg(sqrt(list_dot_product(w, w)) / sqrt(list_dot_product(v, v))), 5) AS norm_ratio, avg(list_cosine_similarity(v, w)) >= 0.98 AS stable FROM n"""
)
def drift(spark, d):
    return stretched_drift(spark, d, "true")


def stretched_drift(spark, d, which: str) -> DataFrame:
    v = vectors(spark, d)
    new = v.where(which).select("id", F.transform("v", lambda x, i: F.when(i == 0, x * F.lit(1.5)).otherwise(x.cast("double"))).alias("v"))
    return ml.drift(v, new).withColumn("cosine", F.round("cosine", 5)).withColumn("norm_ratio", F.round("norm_ratio", 5))


@query()
def als_factors(spark, d):
    return ml.als_factors(catalog(spark, d).interactions)


@query()
def spectral_embedding(spark, d):
    return ml.spectral_embedding(op.strongest(op.symmetric(op.tag_pairs(catalog(spark, d).work_tags)), 24))


# -- pages -------------------------------------------------------------------------------------------------------------


@query(
    """WITH l AS (SELECT page_id, url, unnest(list_distinct(list_filter(regexp_extract_all(html, '(?i)href="([^"#]*)', 1), lambda h: h <> ''))) AS h FROM pages),
    a AS (SELECT page_id, url, CASE WHEN regexp_matches(h, '^https?://') THEN h WHEN starts_with(h, '//') THEN 'https:' || h WHEN starts_with(h, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || h WHEN NOT regexp_matches(h, '^[a-z]+:') THEN regexp_extract(url, '^(https?://[^?#]*/)', 1) || h END AS link FROM l)
    SELECT DISTINCT page_id, link FROM a WHERE link IS NOT NULL AND regexp_extract(link, '^https?://([^/?#]+)', 1) = regexp_extract(url, '^https?://([^/?#]+)', 1)"""
)
def extract_links(spark, d):
    return ht.same_host_links(table(spark, d, "pages"), "page_id", "url", "html")


@query(
    """SELECT page_id, sha256(t) AS digest, length(t) AS chars FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM pages)"""
)
def strip_html(spark, d):
    t = ht.stripped(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.sha2(t, 256).alias("digest"), F.length(t).cast("long").alias("chars"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)) AS title, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_matches(html, '(?i)(just a moment|checking your browser|enable javascript and cookies)') AS interstitial FROM pages")
def page_records(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", ht.title_of(h).alias("title"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), ht.is_interstitial(h).alias("interstitial"))


@query(
    """, e AS (SELECT user_id FROM reads GROUP BY 1 HAVING count(*) >= 30), c AS (SELECT user_id, tag, count(*) AS n FROM reads JOIN e USING (user_id) JOIN carried USING (work_id) GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, tag) AS rn FROM c)
    SELECT substr(sha256('salt' || user_id), 1, 32) AS reader, tag, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share FROM k WHERE rn <= 10""",
    "reads carried",
)
def reader_profile_shares(spark, d):
    return profiles(catalog(spark, d)).select("reader", "tag", "n", F.round("share", 6).alias("share"))


def profiles(r, k: int = 30, top: int = 10) -> DataFrame:
    """Top tags of readers of k works or more, as shares, under a pseudonym."""
    c = op.reads(r.interactions).join(op.k_anonymous(r.interactions, k).select("user_id"), "user_id").join(op.carried(r.work_tags), "work_id").groupBy("user_id", "tag").agg(F.count("*").alias("n"))
    c = c.withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("n"), "tag"))).where(F.col("rn") <= top)
    return c.select(ht.pseudonym(F.col("user_id"), "salt").alias("reader"), "tag", "n", (F.col("n") / F.sum("n").over(W.partitionBy("user_id"))).alias("share"))


@query()
def shards(spark, d):
    return ht.shard_table(profiles(catalog(spark, d)), "reader").select("shard", "rows", "digest")


@query(
    """, g AS (SELECT authors AS name, count(*) AS works FROM works GROUP BY 1), t AS (SELECT sum(sqrt(works)) AS roots, count(*) AS n FROM g)
    SELECT name, works, least(2 + floor(greatest(0, 150 - 2 * n) * round(sqrt(works) / roots, 12)), works, 60)::BIGINT AS quota FROM g, t""",
    "works",
)
def quota_plan(spark, d):
    g = catalog(spark, d).works.groupBy(F.col("authors").alias("name")).agg(F.count("*").alias("works"))
    return ht.quota_plan(g, 150, 2, 60)


@query(
    """, l AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY co DESC, dst) AS rn FROM sym) WHERE rn <= 3),
    s AS (SELECT min(tag) AS node FROM df), f1 AS (SELECT DISTINCT dst AS node FROM l JOIN s ON src = node WHERE dst NOT IN (SELECT node FROM s)),
    f2 AS (SELECT DISTINCT dst AS node FROM l JOIN f1 ON src = node WHERE dst NOT IN (SELECT node FROM s) AND dst NOT IN (SELECT node FROM f1))
    SELECT node, 0 AS depth FROM s UNION ALL SELECT node, 1 FROM f1 UNION ALL SELECT node, 2 FROM f2""",
    "sym df",
)
def frontier_walk(spark, d):
    t = catalog(spark, d).work_tags
    links = op.strongest(op.symmetric(op.tag_pairs(t)), 3).select("src", "dst")
    return ht.frontier(op.doc_frequency(t).agg(F.min("tag").alias("node")), links, 2)

"""Queries for shelves, harvests, authors by profile, themes and fingerprints, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import corpus as op
from quillspark.operators import ranking as rk
from quillspark.operators import shelves as sh
from quillspark.operators import upkeep as up
from quillspark.plans.assess import six
from quillspark.plans.corpus import vectors
from quillspark.plans.ranking import tag_vectors
from quillspark.plans.registry import query
from quillspark.sources.tables import catalog

# -- the shelf of the reader of least id; brands and types are the catalogue's universes ---------------------------------------

SHELF = """, me AS (SELECT work_id FROM reads WHERE user_id = (SELECT min(user_id) FROM reads)), tw AS (SELECT tag, count(*) / (1 + ln(1 + df)) AS t FROM carried JOIN df USING (tag) JOIN me USING (work_id) GROUP BY tag, df), ta AS (SELECT tag, t / (SELECT max(t) FROM tw) AS w FROM tw),
    nt AS (SELECT work_id, count(*) AS n FROM carried GROUP BY 1), ws AS (SELECT work_id, round(sum(w) / (1 + ln(n)), 9) AS s FROM carried JOIN ta USING (tag) JOIN nt USING (work_id) GROUP BY work_id, n),
    cf AS (SELECT lower(tag) AS name, count(*) * 3 AS cat FROM work_tags WHERE tag_type IN ('brand', 'type') GROUP BY 1), fw AS (SELECT DISTINCT name AS universe, work_id FROM carried JOIN cf ON lower(tag) = name),
    tp AS (SELECT universe, s, row_number() OVER (PARTITION BY universe ORDER BY s DESC, work_id) AS rn FROM fw JOIN ws USING (work_id)), sc AS (SELECT universe, round(avg(s), 9) AS score FROM tp WHERE rn <= 25 GROUP BY 1),
    sz AS (SELECT universe, count(*) AS n FROM fw GROUP BY 1), mn AS (SELECT universe, count(*) AS m FROM fw JOIN me USING (work_id) GROUP BY 1),
    ru AS (SELECT universe, n, score, cat AS catalogue, coalesce(m, 0) AS bookmarked FROM sc JOIN sz USING (universe) JOIN cf ON name = universe LEFT JOIN mn USING (universe) WHERE n >= 3 ORDER BY score DESC, n DESC, universe LIMIT 30)"""


def shelf_parts(spark, d):
    r = catalog(spark, d)
    reads = op.reads(r.interactions)
    me = reads.join(F.broadcast(reads.agg(F.min("user_id").alias("user_id"))), "user_id", "left_semi").select("work_id")
    names = r.work_tags.where("tag_type in ('brand', 'type')").groupBy(F.col("tag").alias("name")).agg((F.count("*") * 3).alias("works"))
    return r, me, names


@query(SHELF + " SELECT universe, n, round(score, 6) AS score, catalogue, bookmarked FROM ru", "reads df work_tags")
def shelf_universes(spark, d):
    r, me, names = shelf_parts(spark, d)
    ranked = sh.ranked_universes(sh.universe_works(r.work_tags, names), sh.taste_scores(me, r.work_tags), names, me, 30)
    return six(ranked, "score")


@query(
    SHELF + """, po AS (SELECT universe, work_id AS id, s, row_number() OVER (PARTITION BY universe ORDER BY round(s * (1 + 0.25 * ln(1 + kudos) / 8), 9) DESC, work_id) AS place FROM fw JOIN ru USING (universe) JOIN ws USING (work_id) JOIN works ON id = work_id)
    SELECT universe, id, round(s, 6) AS s, place FROM po WHERE place <= 40""",
    "reads df work_tags works",
)
def shelf_pool(spark, d):
    r, me, names = shelf_parts(spark, d)
    members, scores = sh.universe_works(r.work_tags, names), sh.taste_scores(me, r.work_tags)
    return six(sh.shelf_pool(members, scores, r.works, sh.ranked_universes(members, scores, names, me, 30), 40), "s")


@query()
def shelf_build(spark, d):
    r, me, names = shelf_parts(spark, d)
    return sh.build_shelf(r.works, r.work_tags, names, me, universes=10, per=20)


@query()
def harvest_fill(spark, d):
    """What isn't held of every brand's works, up to a tenth of them."""
    r = catalog(spark, d)
    taste = r.work_tags.groupBy("tag").agg((F.count("*") % 5 / 4.0).alias("weight"))
    tags = rk.tag_sets(r.work_tags).withColumnRenamed("work_id", "id")
    found = up.harvest_score(r.works, r.work_tags, taste).join(r.works.select("id", F.col("authors").alias("universe")), "id").join(tags, "id")
    quotas = r.works.groupBy(F.col("authors").alias("universe")).agg(F.ceil(F.count("*") / 10).alias("quota"))
    return sh.harvest_fill(found, r.works.where("kudos % 2 = 0").select("id"), quotas)


@query(
    """, sd AS (SELECT id FROM works WHERE lower(authors) LIKE '%brand#22%'), pf AS (SELECT tag, df, count(*) * CASE WHEN df >= n THEN 0 ELSE ln(n / df) END AS w FROM carried JOIN df USING (tag), total WHERE df >= 3 AND work_id IN (SELECT id FROM sd) GROUP BY tag, df, n),
    kp AS (SELECT tag, w FROM pf WHERE w > 0 ORDER BY df, tag LIMIT 24), ca AS (SELECT id, authors FROM works WHERE id IN (SELECT work_id FROM carried JOIN kp USING (tag)) ORDER BY kudos DESC, id LIMIT 5000),
    nb AS (SELECT id, authors AS author FROM ca WHERE lower(authors) <> 'brand#22'), pt AS (SELECT DISTINCT author, tag, w FROM nb JOIN carried ON work_id = id JOIN kp USING (tag)),
    dt AS (SELECT author, sum(w) AS dot, count(*) AS shared FROM pt GROUP BY 1), wk AS (SELECT author, count(*) AS works FROM nb GROUP BY 1)
    SELECT author, works, round(dot / (sqrt((SELECT sum(w * w) FROM kp)) * sqrt(shared)), 6) AS score FROM dt JOIN wk USING (author) ORDER BY round(dot / (sqrt((SELECT sum(w * w) FROM kp)) * sqrt(shared)), 9) DESC, works DESC, author LIMIT 10""",
    "works df total",
)
def authors_like(spark, d):
    r = catalog(spark, d)
    return six(sh.authors_like(r.works, r.work_tags, "Brand#22"), "score")


# -- themes: twelve families by id, the last eight below the first four ------------------------------------------------------

FAMILIES = ", fa AS (SELECT id % 12 AS id, CASE WHEN id % 12 >= 4 THEN id % 12 % 4 END AS parent, 'theme ' || id % 12 AS label, count(*) AS size FROM works GROUP BY 1, 2, 3), ut AS (SELECT coalesce(fa.parent, fa.id) AS top, works.id AS work, title FROM works JOIN fa ON fa.id = works.id % 12)"


def families(works: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = F.col("id") % 12
    members = works.select(F.col("id").alias("work"), n.alias("family"))
    rows = members.groupBy(F.col("family").alias("id")).agg(F.count("*").alias("size"))
    return rows.select("id", F.when(F.col("id") >= 4, F.col("id") % 4).alias("parent"), F.concat(F.lit("theme "), "id").alias("label"), "size"), members


@query(
    FAMILIES + """, f3 AS (SELECT *, row_number() OVER (PARTITION BY top ORDER BY work) AS rn FROM ut)
    SELECT id, label, size, (SELECT string_agg(work || ':' || title, ',' ORDER BY work) FROM f3 WHERE top = id AND rn <= 3) AS sample FROM fa WHERE parent IS NULL""",
    "works",
)
def themes(spark, d):
    w = catalog(spark, d).works
    shown = F.array_join(F.transform("sample", lambda s: F.concat_ws(":", s["work"].cast("string"), s["title"])), ",")
    return sh.themes(*families(w), w).withColumn("sample", shown)


@query(FAMILIES + " SELECT work, title FROM ut WHERE top = 2 ORDER BY work LIMIT 50", "works")
def theme_works(spark, d):
    w = catalog(spark, d).works
    return sh.theme_works(*families(w), w, 2, 50)


@query()
def divided_families(spark, d):
    """Tags' vectors by their first letter, each letter's tags cut in four."""
    t = catalog(spark, d).work_tags
    v = tag_vectors(spark, d, t).join(op.doc_frequency(t), "tag")
    return sh.divide(v.select((F.ascii("tag") % 7).cast("long").alias("family"), F.xxhash64("tag").alias("id"), F.col("df").alias("support"), "v"), 4)


# -- fingerprints ------------------------------------------------------------------------------------------------------

PRINT = """em AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, CASE WHEN vec_id % 16 = 3 THEN list_transform(embedding::DOUBLE[], lambda x: 0 * x) WHEN vec_id % 16 = 5 THEN list_reverse(embedding::DOUBLE[]) ELSE list_transform(embedding::DOUBLE[], lambda x: 1.05 * x) END AS w FROM embeddings),
    nm AS (SELECT count(*) AS n, avg(sqrt(list_dot_product(v, v))) AS nv, avg(sqrt(list_dot_product(w, w))) AS nw FROM em), cv AS (SELECT i, avg(x) AS x, avg(y) AS y FROM (SELECT unnest(v) AS x, unnest(w) AS y, generate_subscripts(v, 1) AS i FROM em) GROUP BY 1),
    sm AS (SELECT *, list_dot_product(v, v) > 0 AND list_dot_product(w, w) > 0 AS moves FROM em WHERE id IN (SELECT id FROM em ORDER BY id LIMIT 64))"""


@query(f"WITH {PRINT} SELECT n AS rows, (SELECT count(*) FROM cv) AS width, round(nv, 6) AS mean_norm, round((SELECT sqrt(sum(x * x)) FROM cv), 6) AS centroid_norm FROM nm")
def embedding_fingerprint(spark, d):
    centre = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x))
    return six(sh.fingerprint(vectors(spark, d)).select("rows", "width", "mean_norm", centre.alias("centroid_norm")), "mean_norm", "centroid_norm")


@query(
    f"""WITH {PRINT}, co AS (SELECT count(*) FILTER (moves) AS sampled, count(*) FILTER (NOT moves) AS empty, avg(list_cosine_similarity(v, w)) FILTER (moves) AS c FROM sm)
    SELECT n AS rows_before, n AS rows_after, round((SELECT sum(x * y) / sqrt(sum(x * x) * sum(y * y)) FROM cv), 6) AS centroid_cosine, round(nw / nv, 6) AS norm_ratio, round(c, 6) AS sample_cosine, sampled, empty,
    CASE WHEN sampled = 0 THEN 'nothing shared' WHEN c < 0.98 THEN 'moved' WHEN nw / nv < 0.9 OR nw / nv > 1.1 THEN 'rescaled' ELSE 'reproduced' END AS verdict FROM nm, co"""
)
def embedding_drift(spark, d):
    v = vectors(spark, d).select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    n = F.col("id") % 16
    new = v.select("id", F.when(n == 3, F.transform("v", lambda x: x * 0)).when(n == 5, F.reverse("v")).otherwise(F.transform("v", lambda x: x * 1.05)).alias("v"))
    return six(sh.drift_between(v, new), "centroid_cosine", "norm_ratio", "sample_cosine")

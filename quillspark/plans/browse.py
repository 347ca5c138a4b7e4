"""Queries for names, search, tag pages, pools and lookups, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import listing as ls
from quillspark.operators import pools
from quillspark.operators import ranking as rk
from quillspark.operators import related as rel
from quillspark.plans.corpus import seeds
from quillspark.plans.ranking import tag_vectors
from quillspark.plans.registry import query
from quillspark.sources.tables import catalog, table

#: Names of universes, other tags and titles made of part names, one of each shape in turn.
NAMES = """names AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN p_name || ' - Fandom' WHEN 1 THEN p_name || ' (Anime)' WHEN 2 THEN p_name || ' - All Media Types' WHEN 3 THEN p_name || ' - freeform'
    WHEN 4 THEN p_name || ' - somebody' WHEN 5 THEN p_name || ' (fix-it)' WHEN 6 THEN p_name ELSE upper(p_name) || ' (fandom)' END AS tag FROM part)"""


def names(spark, d) -> DataFrame:
    p, n = table(spark, d, "part"), F.col("p_name")
    ends = [" - Fandom", " (Anime)", " - All Media Types", " - freeform", " - somebody", " (fix-it)", ""]
    made = F.concat(F.upper(n), F.lit(" (fandom)"))
    for k, e in enumerate(ends):
        made = F.when(F.col("p_partkey") % 8 == k, F.concat(n, F.lit(e))).otherwise(made)
    return p.select(F.col("p_partkey").alias("id"), made.alias("tag"))


LOOKS = "(low LIKE '% - all media types' OR low LIKE '% - fandom' OR low LIKE '% (fandom)' OR regexp_extract(low, '\\(([^()]{1,60})\\)$', 1) IN ('anime', 'manga', 'visual novel', 'video game', 'book', 'movie', 'fandom'))"
CANON = "CASE WHEN low LIKE '% - all media types' THEN trim(low[:-19]) WHEN low LIKE '% - fandom' THEN trim(low[:-10]) WHEN low LIKE '% (fandom)' THEN trim(low[:-10]) ELSE trim(regexp_replace(low, '\\s*\\([^()]{1,60}\\)$', '')) END"


@query(f"WITH {NAMES}, l AS (SELECT id, tag, lower(trim(tag)) AS low FROM names) SELECT id, {LOOKS} AS looks, {CANON} AS canonical FROM l")
def universe_names(spark, d):
    return names(spark, d).select("id", ls.looks_like_universe(F.col("tag")).alias("looks"), ls.canonical(F.col("tag")).alias("canonical"))


@query(
    f"""WITH {NAMES}, l AS (SELECT DISTINCT tag, lower(trim(tag)) AS low FROM names), b AS (SELECT DISTINCT trim(regexp_extract(low, '^(.*) - (all media types|fandom)$', 1)) AS base FROM l WHERE low LIKE '% - all media types' OR low LIKE '% - fandom'),
    s AS (SELECT tag, trim(regexp_extract(low, '^(.+) - (.*)$', 1)) AS l, trim(regexp_extract(low, '^(.+) - (.*)$', 2)) AS r, regexp_extract(low, '^(.+) \\((.*)\\)$', 2) AS q, trim(regexp_extract(low, '^(.+) \\((.*)\\)$', 1)) AS p FROM l)
    SELECT tag, CASE WHEN l <> '' THEN r IN ('all media types', 'fandom') OR (r <> 'freeform' AND l IN (SELECT base FROM b)) ELSE q = 'anime' END AS universe,
    CASE WHEN l <> '' AND (r IN ('all media types', 'fandom') OR l IN (SELECT base FROM b)) THEN l WHEN q = 'anime' THEN p ELSE '' END AS base FROM s"""
)
def universe_by_shape(spark, d):
    return ls.by_shape(names(spark, d).select("tag").distinct())


@query(f"WITH {NAMES} SELECT lower(trim(tag)) AS name, min(id) AS id FROM names GROUP BY 1")
def first_seen_names(spark, d):
    return ls.first_seen_names(names(spark, d))


@query(
    f"""WITH {NAMES}, dec AS (SELECT DISTINCT tag, false AS explicit FROM names WHERE id % 8 IN (0, 5) UNION ALL SELECT DISTINCT tag || '?', true FROM names WHERE id % 8 = 1 UNION ALL SELECT DISTINCT tag, true FROM names WHERE id % 8 = 3)
    SELECT tag, CASE WHEN tag LIKE '%?' THEN 'missing' WHEN explicit THEN 'explicit' WHEN tag LIKE '% - Fandom' THEN 'present' ELSE 'not a universe' END AS state FROM dec"""
)
def universe_check(spark, d):
    n = names(spark, d)
    pick = lambda w, e, tail="": n.where(w).select(F.concat("tag", F.lit(tail)).alias("tag")).distinct().withColumn("explicit", F.lit(e))
    return ls.universe_check(pick("id % 8 in (0, 5)", False).union(pick("id % 8 = 1", True, "?")).union(pick("id % 8 = 3", True)), n)


@query(
    """WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '[' || p_brand || '] ' || p_name || '!' WHEN 1 THEN p_name || ' (' || p_type || ') more' WHEN 2 THEN '(un)' || p_name || '_x' ELSE p_name || ' [open' END AS title FROM part),
    m AS (SELECT id, coalesce(nullif(regexp_extract(lower(title), '^[\\[(][^\\])]*[\\])] *(.+)$', 1), ''), lower(title)) AS n FROM t),
    c AS (SELECT id, coalesce(nullif(regexp_extract(n, '^(.[^\\[(]*)[\\[(].*[\\])]', 1), ''), n) AS n FROM m)
    SELECT id, trim(regexp_replace(n, '[^a-z0-9]+', ' ', 'g')) AS key FROM c"""
)
def title_keys(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey") % 4
    t = F.when(k == 0, F.concat(F.lit("["), "p_brand", F.lit("] "), "p_name", F.lit("!"))).when(k == 1, F.concat("p_name", F.lit(" ("), "p_type", F.lit(") more"))).when(k == 2, F.concat(F.lit("(un)"), "p_name", F.lit("_x"))).otherwise(F.concat("p_name", F.lit(" [open")))
    return p.select(F.col("p_partkey").alias("id"), ls.title_key(t).alias("key"))


@query("SELECT tag, df AS works FROM df WHERE contains(lower(tag), 'an')", "df")
def tag_search(spark, d):
    return ls.tag_search(catalog(spark, d).work_tags, "AN")


@query("SELECT id, kudos FROM works WHERE NOT complete AND language = 'English' AND id IN (SELECT work_id FROM carried WHERE tag = 'Brand#11')", "works carried")
def tag_page(spark, d):
    r = catalog(spark, d)
    return ls.tag_page(r.works, r.work_tags, "Brand#11", " WIP", "english").select("id", "kudos")


@query("SELECT tag, count(DISTINCT work_id) AS works, count(DISTINCT work_id) FILTER (complete) AS shown FROM carried JOIN works ON work_id = id GROUP BY 1", "works carried")
def tag_page_totals(spark, d):
    r = catalog(spark, d)
    return ls.page_totals(r.works, r.work_tags)


@query("SELECT id, kudos FROM works WHERE id IN (SELECT work_id FROM carried WHERE tag = 'Brand#11') ORDER BY kudos DESC, id LIMIT 40", "works carried")
def tag_works_by_kudos(spark, d):
    r = catalog(spark, d)
    return rk.op.top_by(ls.tag_page(r.works, r.work_tags, "Brand#11"), "kudos", 40).select("id", "kudos")


@query("SELECT id, hits FROM works WHERE id IN (SELECT work_id FROM carried WHERE tag = 'Brand#12') ORDER BY hits DESC, id LIMIT 40", "works carried")
def arena_candidates(spark, d):
    r = catalog(spark, d)
    return rk.op.top_by(ls.tag_page(r.works, r.work_tags, "Brand#12"), "hits", 40).select("id", "hits")


@query("SELECT seed AS id, title, kudos, tags FROM seeds JOIN works ON id = seed JOIN (SELECT work_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM carried GROUP BY 1) ON work_id = seed", "works carried seeds")
def slim_lookup(spark, d):
    r = catalog(spark, d)
    s = seeds(r.works).select(F.col("seed").alias("id"))
    return ls.slim_lookup(r.works, r.work_tags, s.union(s)).select("id", "title", "kudos", F.array_join("tags", ",").alias("tags"))


@query(
    """, own AS (SELECT id, 'tagged' AS kind, row_number() OVER (ORDER BY kudos DESC, id) AS turn FROM works WHERE id IN (SELECT work_id FROM carried WHERE tag = 'Brand#11')),
    new AS (SELECT id, 'taste' AS kind, row_number() OVER (ORDER BY hits DESC, id) AS turn FROM works WHERE id NOT IN (SELECT work_id FROM carried WHERE tag = 'Brand#11')),
    b AS (SELECT * FROM own WHERE turn <= 30 UNION ALL SELECT * FROM new WHERE turn <= 30), p AS (SELECT id, kind, row_number() OVER (ORDER BY turn, kind DESC) AS place FROM b) SELECT * FROM p WHERE place <= 30""",
    "works carried",
)
def taste_blend(spark, d):
    r = catalog(spark, d)
    return ls.taste_blend(r.works, r.work_tags, "Brand#11", r.works.select("id", F.col("hits").alias("score")), 30)


@query(
    """, r AS (SELECT DISTINCT user_id, lower(authors) AS author FROM reads JOIN works ON work_id = id), u AS (SELECT DISTINCT user_id FROM r WHERE author IN ('brand#11', 'brand#12'))
    SELECT author, count(*) AS readers FROM r WHERE user_id IN (SELECT user_id FROM u) AND author NOT IN ('brand#11', 'brand#12') GROUP BY 1 ORDER BY readers DESC, author LIMIT 10""",
    "works reads",
)
def co_readers_from(spark, d):
    r = catalog(spark, d)
    return ls.co_readers_from(r.works, r.interactions, spark.createDataFrame([("brand#11",), ("brand#12",)], "author string"), 10)


@query(
    """, r AS (SELECT DISTINCT user_id, lower(authors) AS author FROM reads JOIN works ON work_id = id), u AS (SELECT DISTINCT user_id FROM r WHERE author = 'brand#11'),
    p AS (SELECT author, count(*) AS readers FROM r WHERE user_id IN (SELECT user_id FROM u) AND author <> 'brand#11' GROUP BY 1 ORDER BY readers DESC, author LIMIT 10),
    t AS (SELECT lower(authors) AS author, sum(hits)::BIGINT AS score FROM works GROUP BY 1 ORDER BY score DESC, author LIMIT 10)
    SELECT author, readers, score FROM p FULL JOIN t USING (author) ORDER BY readers DESC NULLS LAST, score DESC NULLS LAST, author LIMIT 15""",
    "works reads",
)
def merged_authors(spark, d):
    r = catalog(spark, d)
    pairs = ls.co_readers_from(r.works, r.interactions, spark.createDataFrame([("brand#11",)], "author string"), 10)
    return ls.merged_authors(pairs, pools.author_popularity(r.works, 10).select("author", F.col("hits").alias("score")), 15)


@query("SELECT lower(authors) AS author, count(*) AS works, sum(hits)::BIGINT AS hits FROM works GROUP BY 1 ORDER BY hits DESC, author LIMIT 20", "works")
def related_author_popular(spark, d):
    return pools.related(catalog(spark, d), "author", "popular")


@query(
    """, u AS (SELECT work_id AS id, tag FROM carried WHERE tag LIKE 'size %'), p AS (SELECT authors AS author, count(*) AS works, sum(kudos)::DOUBLE AS score FROM works GROUP BY 1),
    x AS (SELECT authors AS author, list_sort(list_distinct(list(tag)))[1:3] AS universes FROM works JOIN u USING (id) GROUP BY 1)
    SELECT author, works, round(score, 4) AS score, array_to_string(universes, ',') AS universes FROM p LEFT JOIN x USING (author) ORDER BY score DESC, author LIMIT 15""",
    "works carried",
)
def shelf_authors(spark, d):
    r = catalog(spark, d)
    u = r.work_tags.where("tag_type = 'size'").select(F.col("work_id").alias("id"), F.col("tag").alias("universe"))
    out = ls.shelf_authors(r.works.select("id", "authors", F.col("kudos").cast("double").alias("score")), u, 15)
    return out.select("author", "works", F.round("score", 4).alias("score"), F.array_join("universes", ",").alias("universes"))


POOL = """, st AS (SELECT DISTINCT tag FROM carried JOIN seeds ON work_id = seed), tg AS (SELECT work_id AS id, row_number() OVER (ORDER BY count(*) DESC, work_id) AS pos FROM carried WHERE tag IN (SELECT tag FROM st) AND work_id NOT IN (SELECT seed FROM seeds) GROUP BY 1),
    sh AS (SELECT s.work_id AS seed, o.work_id AS other, count(*) AS co FROM reads s JOIN reads o ON s.user_id = o.user_id AND s.work_id <> o.work_id WHERE s.work_id IN (SELECT seed FROM seeds) GROUP BY 1, 2), nr AS (SELECT work_id, count(*) AS n FROM reads GROUP BY 1),
    sm AS (SELECT seed, other, round(co / sqrt(x.n * y.n) * co / (co + 100), 9) AS sim FROM sh JOIN nr x ON x.work_id = seed JOIN nr y ON y.work_id = other),
    vt AS (SELECT other AS id, round(sum(sim), 9) AS vote FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY sim DESC, other) AS rn FROM sm) WHERE rn <= 50 AND other NOT IN (SELECT seed FROM seeds) GROUP BY 1),
    cv AS (SELECT id, row_number() OVER (ORDER BY vote DESC, id) AS pos FROM vt),
    al AS (SELECT id, pos, 0 AS source FROM tg WHERE pos <= 175 UNION ALL SELECT id, pos, 1 FROM cv WHERE pos <= 25 UNION ALL SELECT id, pos, 2 FROM tg WHERE pos BETWEEN 176 AND 200),
    fs AS (SELECT id, min((source, pos)) AS m FROM al GROUP BY 1)
    SELECT id, m[1] AS source, row_number() OVER (ORDER BY m, id) AS place FROM fs ORDER BY m, id LIMIT 200"""


@query(POOL.replace("m[1] AS source", "struct_extract_at(m, 1) AS source"), "works carried reads seeds")
def candidate_pool(spark, d):
    """Without vectors, which the twin has no word for; recommend runs it with them."""
    r = catalog(spark, d)
    return pools.candidate_pool(r.works, r.work_tags, r.interactions, None, seeds(r.works), 200, fixed=True)


@query()
def candidate_pool_all(spark, d):
    """The pool from all four sources; rows only (the walk is iterative)."""
    r = catalog(spark, d)
    edges = rk.op.symmetric(rk.op.tag_pairs(r.work_tags))
    mass = rel.personal_walk(edges, rk.seed_tags(r.work_tags, seeds(r.works)))
    return pools.candidate_pool(r.works, r.work_tags, r.interactions, tag_vectors(spark, d, r.work_tags), seeds(r.works), 200, mass=mass.select("tag", "mass"))


@query(
    """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f FROM embeddings), s AS (SELECT f AS sf FROM v WHERE id < 8)
    SELECT id, round(greatest(0.0, max(list_cosine_similarity(f, sf))), 6) AS value FROM v, s GROUP BY 1"""
)
def signal_latent(spark, d):
    f = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    out = pools.latent(f, f.select(F.col("id").alias("seed")))
    return out.select("id", F.round("value", 6).alias("value"))

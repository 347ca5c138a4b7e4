"""Queries for profiles, agreement, pairing, upkeep and scalar functions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import scoring as fn
from quillspark.operators import corpus as op
from quillspark.operators import ranking as rk
from quillspark.operators import upkeep as up
from quillspark.plans import corpus as pc
from quillspark.plans import experiments as px
from quillspark.plans.ranking import HEAD, RATED, ratings
from quillspark.plans.registry import SQL, query
from quillspark.sources import html as ht
from quillspark.sources.tables import catalog, table


def fresh(works: DataFrame) -> DataFrame:
    """A crawl of every fifth work and of ten new ones: counts moved, some bookmarks unknown."""
    w = works.where("id % 5 = 0").withColumn("id", F.when(F.col("id") % 50 == 0, F.col("id") + 1_000_000).otherwise(F.col("id")))
    w = w.withColumn("kudos", F.col("kudos") + F.col("id") % 7).withColumn("bookmarks", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("bookmarks")))
    return w.withColumn("title", F.when(F.col("id") % 15 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))


FRESH = """, fresh AS (SELECT CASE WHEN id % 50 = 0 THEN id + 1000000 ELSE id END AS id, title, kudos, bookmarks, word_count FROM works WHERE id % 5 = 0),
    fr AS (SELECT id, CASE WHEN id % 15 = 0 THEN title || '!' ELSE title END AS title, kudos + id % 7 AS kudos, CASE WHEN id % 3 = 0 THEN NULL ELSE bookmarks END AS bookmarks, word_count FROM fresh)"""


@query(FRESH + " SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.title ELSE n.title END AS title, CASE WHEN n.id IS NULL THEN o.kudos ELSE n.kudos END AS kudos, coalesce(n.bookmarks, o.bookmarks) AS bookmarks FROM works o FULL JOIN fr n ON o.id = n.id", "works")
def works_upsert(spark, d):
    w = catalog(spark, d).works
    return up.upsert_works(w, fresh(w)).select("id", "title", "kudos", "bookmarks")


@query(
    FRESH + """, b AS (SELECT o.title AS ot, n.title AS nt, o.kudos AS ok, n.kudos AS nk, o.word_count AS ow, n.word_count AS nw FROM works o JOIN fr n USING (id)),
    u AS (SELECT 'title' AS field, CASE WHEN ot = nt THEN 'same' ELSE 'mismatch' END AS kind FROM b UNION ALL SELECT 'word_count', CASE WHEN ow = nw THEN 'same' ELSE 'mismatch' END FROM b
     UNION ALL SELECT 'kudos', CASE WHEN ok = nk THEN 'same' WHEN abs(nk - ok) <= 0.005 * greatest(abs(ok), 1) THEN 'drift' ELSE 'mismatch' END FROM b)
    SELECT field, kind, count(*) AS works FROM u GROUP BY 1, 2""",
    "works",
)
def stored_record_qa(spark, d):
    w = catalog(spark, d).works
    return up.field_drift(w, fresh(w), ["title", "word_count"], {"kudos": 0.005})


DEC = "CASE WHEN kudos > 0 THEN (least(4, greatest(0, ceil(round(log10(greatest(kudos, 1)), 12)))) + kudos / pow(10, least(4, greatest(0, ceil(round(log10(greatest(kudos, 1)), 12))))) - 1) / 4 ELSE 0.05 END"


@query(f", w AS (SELECT id AS work_id, {DEC} AS w FROM works), s AS (SELECT tag, sum(w) AS s FROM carried JOIN w USING (work_id) GROUP BY 1) SELECT tag, round(s / (SELECT max(s) FROM s), 6) AS weight FROM s", "works carried")
def profile_from_works(spark, d):
    r = catalog(spark, d)
    return up.profile_from_works(r.works.select("id"), r.works, r.work_tags).withColumn("weight", F.round("weight", 6))


PROFILE = ", rt AS (SELECT id AS work_id, id % 10 + 1 AS rating, 0.5 + (id % 4) / 4 AS conf FROM works), s AS (SELECT tag, sum((rating - 5.5) * conf) / (sum(conf) + 3) AS s FROM carried JOIN rt USING (work_id) GROUP BY 1), prof AS (SELECT tag, s / (SELECT max(abs(s)) FROM s) AS weight FROM s)"


def rated_profile(r, which: str = "true") -> DataFrame:
    rated = r.works.where(which).select("id", (F.col("id") % 10 + 1).alias("rating"), (0.5 + (F.col("id") % 4) / 4).alias("confidence"))
    return up.profile_from_ratings(rated, r.work_tags)


@query(PROFILE + " SELECT tag, round(weight, 6) AS weight FROM prof", "works carried")
def profile_from_ratings(spark, d):
    return rated_profile(catalog(spark, d)).withColumn("weight", F.round("weight", 6))


@query(PROFILE + " SELECT work_id AS id, round(coalesce(sum(weight), 0) / sqrt(count(*)), 6) AS score FROM carried LEFT JOIN prof USING (tag) GROUP BY 1", "works carried")
def profile_score(spark, d):
    r = catalog(spark, d)
    return up.profile_score(r.work_tags, rated_profile(r)).withColumn("score", F.round("score", 6))


SHELF = ", rd AS (SELECT DISTINCT work_id FROM reads WHERE user_id = (SELECT min(user_id) FROM reads)), tt AS (SELECT tag, count(*) / (1 + ln(1 + any_value(df.df))) AS t FROM carried JOIN rd USING (work_id) JOIN df USING (tag) GROUP BY 1), ta AS (SELECT tag, t / (SELECT max(t) FROM tt) AS taste FROM tt)"


def first_reader(r) -> DataFrame:
    x = op.reads(r.interactions)
    return x.join(F.broadcast(x.agg(F.min("user_id").alias("user_id"))), "user_id").select("work_id")


@query(SHELF + " SELECT tag, round(taste, 6) AS taste FROM ta", "reads carried df")
def shelf_taste(spark, d):
    r = catalog(spark, d)
    return up.shelf_taste(first_reader(r), r.work_tags).withColumn("taste", F.round("taste", 6))


@query(
    SHELF + """, sc AS (SELECT work_id AS id, coalesce(sum(taste), 0) / (1 + ln(count(*))) AS s FROM carried LEFT JOIN ta USING (tag) GROUP BY 1), f AS (SELECT id, round(s * (1 + 0.25 * ln(1 + kudos) / 8), 9) AS score FROM sc JOIN works USING (id) WHERE id NOT IN (SELECT work_id FROM rd))
    SELECT id, round(score, 5) AS score FROM f ORDER BY f.score DESC, id LIMIT 40""",
    "works reads carried df",
)
def shelf_scores(spark, d):
    r = catalog(spark, d)
    return up.shelf_scores(first_reader(r), r.works, r.work_tags, 40).withColumn("score", F.round("score", 5))


VEC = ", ov AS (SELECT user_id AS owner, k % 30 AS tag, avg(value) - 50 AS weight FROM evt GROUP BY 1, 2)"


def owner_vectors(spark, d, which: str = "true") -> DataFrame:
    e = pc.events(spark, d).where(which)
    return e.groupBy(F.col("user_id").alias("owner"), (F.col("k") % 30).alias("tag")).agg((F.avg("value") - 50).alias("weight"))


AGREE = """ SELECT x.owner AS x, y.owner AS y, count(*) AS shared, round(sum(x.weight * y.weight) / sqrt(any_value(a.n) * any_value(b.n)), 6) AS agree FROM ov x JOIN ov y ON x.tag = y.tag AND x.owner < y.owner
    JOIN (SELECT owner, sum(weight * weight) AS n FROM ov GROUP BY 1) a ON a.owner = x.owner JOIN (SELECT owner, sum(weight * weight) AS n FROM ov GROUP BY 1) b ON b.owner = y.owner GROUP BY 1, 2 HAVING count(*) >= 5"""


@query(VEC + AGREE, "evt")
def agreement(spark, d):
    return up.agreement(owner_vectors(spark, d), digits=6)


@query(VEC + " SELECT x.owner AS x, y.owner AS y, count(*) AS shared, round(sum(x.weight * y.weight) / sqrt(sum(x.weight * x.weight) * sum(y.weight * y.weight)), 6) AS agree FROM ov x JOIN ov y ON x.tag = y.tag AND x.owner < y.owner GROUP BY 1, 2 HAVING count(*) >= 5", "evt")
def agreement_literal(spark, d):
    return up.agreement(owner_vectors(spark, d), literal=True, digits=6)


@query(VEC + f", ag AS ({AGREE}) SELECT x, y, round(agree * agree, 5) AS influence FROM ag WHERE agree > 0 AND agree * agree >= 0.05", "evt")
def influence(spark, d):
    a = up.agreement(owner_vectors(spark, d), digits=6)
    return up.influence(a).select("x", "y", F.round("influence", 5).alias("influence"))


PAIRS = RATED + px.GAMES + """, c AS (SELECT id, mu, phi, id % 4 AS games, (id % 5 - 2) / 4 AS affinity FROM rated ORDER BY phi DESC, id LIMIT 40),
    p AS (SELECT x.id AS a, y.id AS b, x.mu AS ma, y.mu AS mb, x.phi AS pa, y.phi AS pb, x.affinity AS fa, y.affinity AS fb, 1 / (1 + ln(1 + x.games)) / (1 + ln(1 + y.games)) AS tired,
     1 / sqrt(1 + 3 * pow(x.phi / 173.7178, 2) / pow(pi(), 2)) AS ga, 1 / sqrt(1 + 3 * pow(y.phi / 173.7178, 2) / pow(pi(), 2)) AS gb FROM c x JOIN c y ON x.id < y.id),
    e AS (SELECT *, 1 / (1 + exp(-gb * (ma - mb) / 173.7178)) AS e FROM p),
    w AS (SELECT a, b, round(tired * ({}), 9) AS worth FROM e WHERE NOT (pa < 80 AND pb < 80 AND abs(ma - mb) > 300) AND abs(ma - mb) <= 1000 AND (a, b) NOT IN (SELECT (least(a, b), greatest(a, b)) FROM games))
    SELECT a, b, round(worth, 6) AS worth FROM w ORDER BY w.worth DESC, a, b LIMIT 10"""
WORTH = {
    "random": "greatest(pa / (350 + pa), pb / (350 + pb)) * (1 - 0.3 * least(1.0, greatest(abs(ma - 1500), abs(mb - 1500)) / 800))", "maxinfo": "ga * gb * e * (1 - e)",
    "close": "1 - abs(ma - mb) / 600", "explore": "1 - fa - fb",
}


def next_pairs(spark, d, strategy: str) -> DataFrame:
    known = ratings(catalog(spark, d).works).withColumn("games", F.col("id") % 4).withColumn("affinity", (F.col("id") % 5 - 2) / 4)
    return up.next_pairs(known, px.games(spark, d), strategy).withColumn("worth", F.round("worth", 6))


@query(PAIRS.format(WORTH["random"]), "works evt")
def pair_selection(spark, d):
    return next_pairs(spark, d, "random")


@query(PAIRS.format(WORTH["maxinfo"]), "works evt")
def pair_selection_maxinfo(spark, d):
    return next_pairs(spark, d, "maxinfo")


@query(PAIRS.format(WORTH["close"]), "works evt")
def pair_selection_close(spark, d):
    return next_pairs(spark, d, "close")


@query(PAIRS.format(WORTH["explore"]), "works evt")
def pair_selection_explore(spark, d):
    return next_pairs(spark, d, "explore")


@query()
def variant_drop(spark, d):
    t = catalog(spark, d).work_tags
    return up.drop_variants(t, t.where("tag_type in ('name', 'type')").select("tag").distinct(), 0.2, 0.1)


@query(f"WITH s AS ({SQL['seasons']}) SELECT month, tag, rank FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY lift DESC, tag) AS rank FROM s) WHERE rank <= 2")
def seasons_per_month(spark, d):
    return up.seasons_per_month(pc.seasons(spark, d), 2)


@query(
    """, taste AS (SELECT DISTINCT tag, (length(tag) % 4 - 1) / 10 AS weight FROM work_tags WHERE tag_type = 'name'), s AS (SELECT work_id AS id, sum(weight) AS s, count(*) AS t FROM carried LEFT JOIN taste USING (tag) GROUP BY 1)
    SELECT id, round(log10(1 + kudos) + 1.5 * log10(1 + coalesce(bookmarks, 0)) + 0.25 * log10(1 + hits) + least(3.0, 3 * coalesce(s, 0) / t * (SELECT count(*) FROM taste) / 4), 6) AS score FROM works JOIN s USING (id)""",
    "works work_tags carried",
)
def harvest_score(spark, d):
    r = catalog(spark, d)
    taste = r.work_tags.where("tag_type = 'name'").select("tag").distinct().withColumn("weight", (F.length("tag") % 4 - 1) / 10)
    return up.harvest_score(r.works, r.work_tags, taste).withColumn("score", F.round("score", 6))


@query(
    """, pr AS (SELECT (SELECT seed FROM seeds LIMIT 1) AS seed, id FROM works WHERE id <> (SELECT seed FROM seeds LIMIT 1)),
    t AS (SELECT pr.seed, pr.id, string_agg(a.tag, ', ' ORDER BY a.tag) FILTER (b.tag IS NOT NULL) AS tags FROM pr JOIN carried a ON a.work_id = pr.seed LEFT JOIN carried b ON b.work_id = pr.id AND b.tag = a.tag GROUP BY 1, 2),
    r AS (SELECT pr.seed, pr.id, count(*) AS n FROM pr JOIN reads a ON a.work_id = pr.seed JOIN reads b ON b.work_id = pr.id AND b.user_id = a.user_id GROUP BY 1, 2)
    SELECT seed, id, coalesce(tags, '') AS by_tags, CASE WHEN n >= 2 THEN n || ' readers of both' END AS by_readers FROM t LEFT JOIN r USING (seed, id)""",
    "works carried reads seeds",
)
def explanation_pair(spark, d):
    r = catalog(spark, d)
    return explained(r, r.works)


def explained(r, works: DataFrame) -> DataFrame:
    pairs = works.select("id").join(F.broadcast(pc.seeds(r.works, 1))).where("id <> seed").select("seed", "id")
    return up.explanation(r.work_tags, r.interactions, pairs)


@query()
def arm_assignment(spark, d):
    owners = table(spark, d, "customer").select(F.col("c_custkey").alias("owner"))
    return owners.select("owner", up.arm_of(F.col("owner"), ["a", "b", "c"]).alias("arm"), up.fnv_id(F.col("owner").cast("string")).alias("id"))


DATES = [("2024-01-31", 1), ("2024-01-31 10:00:00", 2), ("2024-01-31T10:00:00.123456Z", 3), ("17 Sep 2008", 4), ("7 Jan 2020", 5), ("", 6), (None, 7), ("junk", 8), ("31 Foo 2020", 9)]


@query(
    "SELECT i, CASE WHEN i <= 3 THEN DATE '2024-01-31' WHEN i = 4 THEN DATE '2008-09-17' WHEN i = 5 THEN DATE '2020-01-07' END AS parsed, CASE WHEN i <= 3 THEN 19753 WHEN i = 4 THEN 14139 WHEN i = 5 THEN 18268 ELSE 0 END AS days, CASE WHEN i <= 3 THEN 2024 WHEN i = 4 THEN 2008 WHEN i IN (5, 9) THEN 2020 END AS year FROM (SELECT unnest(range(1, 10)) AS i)"
)
def parsed_dates(spark, d):
    s = spark.createDataFrame(DATES, "s string, i long")
    return s.select("i", fn.parsed_date(F.col("s")).alias("parsed"), fn.epoch_days(F.col("s")).alias("days"), fn.year_of(F.col("s")).alias("year"))


@query("SELECT count(*) AS n, min(len(embedding)) AS least_dim, max(len(embedding)) AS most_dim FROM embeddings")
def embedding_stats(spark, d):
    return table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("least_dim"), F.max(F.size("embedding")).cast("long").alias("most_dim"))


@query("SELECT (SELECT count(DISTINCT work_id) FROM reads) AS works, (SELECT count(DISTINCT user_id) FROM reads) AS users, (SELECT count(*) FROM reads) AS marks", "reads")
def reading_stats(spark, d):
    return op.reads(catalog(spark, d).interactions).agg(F.countDistinct("work_id").alias("works"), F.countDistinct("user_id").alias("users"), F.count("*").alias("marks"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def interaction_kinds(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS judged FROM events GROUP BY 1")
def session_counters(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("judged"))


@query(", clk AS (SELECT max(ts) AS now FROM evt) SELECT event_id FROM evt, clk WHERE event_type = 'view' AND epoch_us(now) - epoch_us(ts) <= 7 * 86400::BIGINT * 1000000", "evt")
def impression_retention(spark, d):
    e = pc.events(spark, d)
    now = e.agg(F.max("ts").alias("now"))
    return e.where("event_type = 'view'").join(F.broadcast(now)).where(F.unix_micros("now") - F.unix_micros("ts") <= 7 * 86400 * 1_000_000).select("event_id")


@query(
    """, own AS (SELECT id FROM works WHERE authors = 'Brand#11'), rd AS (SELECT DISTINCT work_id FROM reads WHERE user_id = (SELECT min(user_id) FROM reads))
    SELECT count(*) AS works, count(*) FILTER (id IN (SELECT work_id FROM rd)) AS read FROM own""",
    "works reads",
)
def author_shelf_progress(spark, d):
    r = catalog(spark, d)
    rd = first_reader(r).select(F.col("work_id").alias("id"), F.lit(True).alias("hit"))
    return r.works.where(F.contains("authors", F.lit("Brand#11"))).where("authors = 'Brand#11'").join(rd, "id", "left").agg(F.count("*").alias("works"), F.count_if(F.coalesce("hit", F.lit(False))).alias("read"))


@query(", rd AS (SELECT DISTINCT work_id FROM reads WHERE user_id = (SELECT min(user_id) FROM reads)) SELECT id, kudos FROM works WHERE contains(authors, 'Brand#1') AND id NOT IN (SELECT work_id FROM rd) ORDER BY kudos DESC, id LIMIT 500", "works reads")
def author_unread(spark, d):
    r = catalog(spark, d)
    w = r.works.where(F.contains("authors", F.lit("Brand#1"))).join(first_reader(r).withColumnRenamed("work_id", "id"), "id", "left_anti")
    return op.top_by(w, "kudos", 500).select("id", "kudos")


@query(
    HEAD + """, hit AS (SELECT work_id FROM carried WHERE tag IN (SELECT tag FROM seed)), o1 AS (SELECT id, row_number() OVER (ORDER BY kudos DESC, id) AS rn FROM works), o2 AS (SELECT id, row_number() OVER (ORDER BY hits DESC, id) AS rn FROM works)
    SELECT 'kudos' AS pool, count(*) AS found FROM o1 WHERE rn <= 100 AND id IN (SELECT work_id FROM hit) UNION ALL SELECT 'hits', count(*) FROM o2 WHERE rn <= 100 AND id IN (SELECT work_id FROM hit)""",
    "works work_tags carried",
)
def pool_recall_probe(spark, d):
    r = catalog(spark, d)
    hit = op.carried(r.work_tags).join(F.broadcast(rk.head_tag(r.work_tags, "name")), "tag").select(F.col("work_id").alias("id"))
    one = lambda c: op.top_by(r.works, c, 100).select("id").join(hit, "id", "left_semi").agg(F.lit(c).alias("pool"), F.count("*").alias("found"))
    return one("kudos").union(one("hits"))


TUNES = {"default": rk.DEFAULT_TUNE, "quality": rk.retuned({"quality": 1.0})[0]}
_ARM = "(SELECT '{arm}' AS arm, id, score FROM (SELECT w.id, round(coalesce(q.value * {quality}, 0) + coalesce(p.value * {popularity}, 0), 5) AS score FROM (SELECT p_partkey::BIGINT AS id FROM part) w LEFT JOIN q ON q.id = w.id LEFT JOIN p ON p.id = w.id) ORDER BY score DESC, id LIMIT 20)"


@query(f"WITH q AS ({SQL['signal_quality']}), p AS ({SQL['signal_popularity']}) " + " UNION ALL ".join("SELECT * FROM " + _ARM.format(arm=a, **{k: t[k] for k in ("quality", "popularity")}) for a, t in TUNES.items()))
def compare_tunes(spark, d):
    """Two tunes side by side over the same candidates: each arm's top twenty."""
    w = catalog(spark, d).works
    value = lambda c: F.round(c, 6).alias("value")
    sig = {"quality": w.select("id", value(fn.quality(F.col("kudos"), F.col("word_count")))), "popularity": w.select("id", value(fn.popularity(F.col("hits"), F.col("kudos"))))}
    arms = [rk.compose(w, sig, t).select(F.lit(a).alias("arm"), "id", F.round("score", 5).alias("score")).orderBy(F.desc("score"), "id").limit(20) for a, t in TUNES.items()]
    return arms[0].union(arms[1])


@query("SELECT page_id, list_distinct(regexp_extract_all(html, '/works/(\\d{1,12})', 1)) AS ids, coalesce(nullif(regexp_extract(html, '(?i)<a[^>]*rel=\"next\"[^>]*href=\"([^\"]*)\"', 1), ''), nullif(regexp_extract(html, '(?i)<a[^>]*href=\"([^\"]*)\"[^>]*rel=\"next\"', 1), '')) AS next FROM pages")
def listing_links(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.array_distinct(F.regexp_extract_all("html", F.lit(r"/works/(\d{1,12})"), F.lit(1))).alias("ids"), ht.next_page(F.col("html")).alias("next"))

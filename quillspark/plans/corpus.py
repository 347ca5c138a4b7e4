"""Queries over the catalog binding: preparation, filters, joins, aggregates, windows, top-k and sets, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import scoring as fn
from quillspark.operators import corpus as op
from quillspark.plans.registry import query
from quillspark.sources.tables import catalog, table

AS_OF = "2001-08-01"


def seeds(works: DataFrame, n: int = 3) -> DataFrame:
    return op.top_by(works, "kudos", n).select(F.col("id").alias("seed"))


@query("SELECT tag, count(*) AS df FROM work_tags GROUP BY 1", "work_tags")
def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    return op.row_frequency(catalog(spark, d).work_tags)


@query("SELECT tag, df, n AS works FROM df, total", "df total")
def doc_frequency_distinct(spark, d):
    r = catalog(spark, d)
    return op.doc_frequency(r.work_tags).join(F.broadcast(r.works.agg(F.count("*").alias("works"))))


@query("SELECT * FROM (SELECT src, dst, co, row_number() OVER (PARTITION BY src ORDER BY co DESC, dst) AS rank FROM sym) WHERE rank <= 24", "sym")
def edges_symmetric_topn(spark, d):
    return op.strongest(op.symmetric(op.tag_pairs(catalog(spark, d).work_tags)), 24)


@query("SELECT a AS tag FROM pairs UNION SELECT b FROM pairs", "pairs")
def graph_nodes(spark, d):
    return op.graph_nodes(op.tag_pairs(catalog(spark, d).work_tags))


@query("SELECT work_id, count(*) AS readers FROM reads GROUP BY 1", "reads")
def bookmark_counts(spark, d):
    return op.bookmark_counts(catalog(spark, d).interactions)


@query("SELECT a.work_id AS a, b.work_id AS b, count(*) AS co FROM reads a JOIN reads b ON a.user_id = b.user_id AND a.work_id < b.work_id GROUP BY 1, 2 HAVING count(*) >= 2", "reads")
def co_bookmark_pairs(spark, d):
    return op.co_bookmarks(catalog(spark, d).interactions, 2)


@query("SELECT count(*) AS pairs, count(*) FILTER (co >= 2) AS firm, CASE WHEN count(*) FILTER (co >= 2) >= 1000 THEN 2 ELSE 1 END AS gate FROM (SELECT a.work_id, b.work_id, count(*) AS co FROM reads a JOIN reads b ON a.user_id = b.user_id AND a.work_id < b.work_id GROUP BY 1, 2)", "reads")
def adaptive_gate(spark, d):
    return op.adaptive_gate(op.co_bookmarks(catalog(spark, d).interactions, 1))


TERMS = "terms AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}]+'), lambda x: length(x) BETWEEN 4 AND 24 AND x NOT IN (" + ", ".join(f"'{w}'" for w in fn.STOPWORDS) + ")))) AS term FROM documents)"


@query(f"WITH {TERMS} SELECT term, count(*) AS df FROM terms GROUP BY 1 HAVING count(*) >= 3 AND count(*) <= 0.2 * (SELECT count(*) FROM documents)")
def summary_term_df(spark, d):
    return op.term_frequency(F.col("text"), table(spark, d, "documents"))


@query("SELECT DISTINCT lower(authors) AS author, user_id FROM interactions JOIN works ON id = work_id", "works interactions")
def author_index(spark, d):
    r = catalog(spark, d)
    return op.author_readers(r.works, r.interactions)


@query(f"SELECT id, word_count, kudos, rating, language FROM works WHERE word_count BETWEEN 10000 AND 40000 AND kudos >= 300 AND complete AND lower(language) IN ('english', 'french') AND date_diff('day', update_date, DATE '{AS_OF}') >= 10", "works")
def works_filtered(spark, d):
    w = op.filtered(catalog(spark, d).works, 10_000, 40_000, 300, True, (), ("ENGLISH", "french"), 10, AS_OF)
    return w.select("id", "word_count", "kudos", "rating", "language")


@query("SELECT id, title FROM works WHERE NOT EXISTS (SELECT 1 FROM work_tags t WHERE t.work_id = id AND lower(t.tag) IN ('brand#17', 'size 3', 'ring'))", "works work_tags")
def blocked_anti_join(spark, d):
    r = catalog(spark, d)
    return op.without_tags(r.works, r.work_tags, spark.createDataFrame([("BRAND#17",), ("size 3",), ("Ring",)], "tag string")).select("id", "title")


SEEN = "seen AS (SELECT DISTINCT 'work:' || k AS entity_id FROM evt WHERE event_type IN ('view', 'purchase'))"


def seen_entities(spark, d):
    e = events(spark, d)
    return e.where(F.col("event_type").isin("view", "purchase")).select(F.concat(F.lit("work:"), F.col("k").cast("string")).alias("entity_id"))


def events(spark, d) -> DataFrame:
    """The event log with its entity k and time in UTC."""
    e = table(spark, d, "events")
    return e.withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"WITH {SEEN} SELECT id FROM works WHERE 'work:' || id NOT IN (SELECT entity_id FROM seen)", "works evt")
def seen_anti_join(spark, d):
    return op.unseen(catalog(spark, d).works, seen_entities(spark, d)).select("id")


@query("SELECT user_id, count(*) AS works FROM reads GROUP BY 1 HAVING count(*) >= 30", "reads")
def k_anonymous_readers(spark, d):
    return op.k_anonymous(catalog(spark, d).interactions, 30)


@query("SELECT s.work_id AS seed, o.work_id AS other, count(*) AS shared FROM reads s JOIN reads o ON s.user_id = o.user_id AND s.work_id <> o.work_id WHERE s.work_id IN (SELECT seed FROM seeds LIMIT 1) GROUP BY 1, 2", "reads seeds")
def shared_readers(spark, d):
    r = catalog(spark, d)
    return op.shared_readers(r.interactions, seeds(r.works, 1))


@query("SELECT s.work_id AS seed, o.work_id AS other, count(*) AS shared FROM reads s JOIN reads o ON s.user_id = o.user_id AND s.work_id <> o.work_id WHERE s.work_id IN (SELECT seed FROM seeds) GROUP BY 1, 2", "reads seeds")
def shared_readers_many(spark, d):
    r = catalog(spark, d)
    return op.shared_readers(r.interactions, seeds(r.works))


@query(
    f"""SELECT id, kudos, string_agg(DISTINCT tag, ',' ORDER BY tag) AS matched, round(log10(kudos + 1) / sqrt(date_diff('day', update_date, DATE '{AS_OF}') + 1), 6) AS score
    FROM works JOIN work_tags ON id = work_id AND tag IN ('size 1', 'size 2', 'size 3', 'size 4', 'size 5')
    WHERE id IN (SELECT work_id FROM work_tags WHERE tag IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#14', 'Brand#15')) AND date_diff('day', update_date, DATE '{AS_OF}') BETWEEN 0 AND 365 GROUP BY id, kudos, update_date""",
    "works work_tags",
)
def family_browse(spark, d):
    r = catalog(spark, d)
    out = op.family_browse(r.works, r.work_tags, [f"BRAND#1{i}" for i in range(1, 6)], [f"Size {i}" for i in range(1, 6)], AS_OF, 365)
    return out.select("id", "kudos", "matched", F.round("score", 6).alias("score"))


@query("SELECT id, title, CASE WHEN lower(title) = 'ring' THEN 1 WHEN starts_with(lower(title), 'ring') THEN 2 ELSE 3 END AS tier FROM works WHERE contains(lower(title), 'ring') OR contains(lower(authors), 'ring')", "works")
def multi_token_search(spark, d):
    return op.search(catalog(spark, d).works, "Ring").select("id", "title", "tier")


def entries(works: DataFrame, which: str = "true") -> DataFrame:
    """Deterministic entries to resolve: exact, misspelt by one letter, and with a foreign author."""
    e = works.where(which).withColumn("m", (F.col("id") / 40 % 3).cast("int"))
    title = F.when(F.col("m") == 1, F.concat("title", F.lit("x"))).otherwise(F.col("title"))
    return e.select(F.col("id").alias("entry"), title.alias("title"), F.when(F.col("m") == 2, "Nobody").otherwise(F.col("authors")).alias("author"))


@query(
    """, e AS (SELECT id AS entry, CASE WHEN (id // 40) % 3 = 1 THEN title || 'x' ELSE title END AS t, CASE WHEN (id // 40) % 3 = 2 THEN 'nobody' ELSE lower(authors) END AS a FROM works),
    m AS (SELECT entry, id, 1 AS method FROM e JOIN works ON lower(title) = lower(t) AND lower(authors) = a
     UNION ALL SELECT entry, id, 2 FROM e JOIN works ON lower(authors) = a AND levenshtein(lower(t), lower(title)) <= 2
     UNION ALL SELECT entry, id, 3 FROM e JOIN works ON lower(title) = lower(t))
    SELECT entry, method, id FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY method, id) AS rn FROM m) WHERE rn = 1""",
    "works",
)
def fuzzy_match(spark, d):
    w = catalog(spark, d).works
    return op.fuzzy_match(entries(w), w)


@query("SELECT DISTINCT work_id, tag, CASE WHEN tag_type = 'name' AND length(tag) % 2 = 0 THEN 'even' ELSE tag_type END AS tag_type FROM work_tags", "work_tags")
def retag_update_from(spark, d):
    t = catalog(spark, d).work_tags
    known = t.where("tag_type = 'name' and length(tag) % 2 = 0").select("tag", F.lit("even").alias("tag_type")).distinct()
    return op.retag(t, known, "name")


@query("SELECT n_regionkey::BIGINT AS shard, change FROM (SELECT DISTINCT n_regionkey, CASE n_regionkey WHEN 0 THEN 'removed' WHEN 1 THEN 'added' WHEN 2 THEN 'changed' END AS change FROM nation) WHERE change IS NOT NULL")
def shard_diff(spark, d):
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("long").alias("shard")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("x")).withColumn("digest", F.sha2("x", 256))
    old = n.where("shard <> 1").select("shard", F.when(F.col("shard") == 2, "stale").otherwise(F.col("digest")).alias("digest"))
    return op.manifest_diff(old, n.where("shard <> 0"))


@query(
    """SELECT tag, count(*) AS works, sum(word_count)::BIGINT AS words, (sum(word_count) // count(*))::BIGINT AS mean_words, list_sort(list(word_count))[count(*) // 2 + 1] AS median_words,
    (sum(kudos) // count(*))::BIGINT AS mean_kudos, list_sort(list(kudos))[count(*) // 2 + 1] AS median_kudos, arg_min(work_id, (-coalesce(bookmarks, 0), work_id)) AS top_work
    FROM carried JOIN works ON id = work_id GROUP BY 1""",
    "carried works",
)
def tag_shelf(spark, d):
    r = catalog(spark, d)
    return op.tag_shelf(r.works, r.work_tags)


@query(
    """, y AS (SELECT tag, year(update_date) AS year, count(*) AS works FROM carried JOIN works ON id = work_id WHERE update_date IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY year DESC) AS rn FROM y)
    SELECT tag, year::INT AS year, works, round(works / max(works) OVER (PARTITION BY tag), 6) AS share FROM k WHERE rn <= 12""",
    "carried works",
)
def tag_shelf_years(spark, d):
    r = catalog(spark, d)
    return op.shelf_years(r.works, r.work_tags).select("tag", "year", "works", F.round("share", 6).alias("share"))


@query("SELECT authors, n, round((total + 10.0 * prior) / (n + 10.0), 6) AS shrunk FROM (SELECT authors, sum(kudos) AS total, count(*) AS n FROM works GROUP BY 1), (SELECT avg(kudos) AS prior FROM works WHERE kudos > 0)", "works")
def shrunk_mean(spark, d):
    return op.shrunk_mean(catalog(spark, d).works, "authors", "kudos").select("authors", "n", F.round("shrunk", 6).alias("shrunk"))


@query("SELECT tag, count(*) AS df FROM work_tags GROUP BY 1 HAVING count(*) >= 3 ORDER BY df DESC, tag LIMIT 30", "work_tags")
def tag_candidates(spark, d):
    return op.tag_candidates(catalog(spark, d).work_tags, 3, 30)


@query("SELECT lower(authors) AS author, count(*) AS works, min(authors) AS name FROM works GROUP BY 1", "works")
def author_head(spark, d):
    return op.author_head(catalog(spark, d).works)


@query(
    """, o AS (SELECT user_id, count(*) AS marks, count(DISTINCT ts::DATE) AS days FROM evt GROUP BY 1), s AS (SELECT list_sort(list(marks / days)) AS v, count(*) AS n, sum(marks)::BIGINT AS marks, sum(days)::BIGINT AS reader_days, count(*) FILTER (days >= 5) AS thick FROM o),
    q AS (SELECT n AS owners, marks, reader_days, thick, v[greatest(1, floor(0.5 * n + 0.999999)::INT)] AS p50, v[greatest(1, floor(0.9 * n + 0.999999)::INT)] AS p90 FROM s)
    SELECT owners, marks, reader_days, thick, round(p50, 6) AS p50, round(p90, 6) AS p90, CASE WHEN thick < greatest(1, floor(owners * 0.2 + 0.5)) THEN 'thin' WHEN p50 > 0 AND p90 / p50 < 2 THEN 'flat' ELSE 'meets' END AS verdict FROM q""",
    "evt",
)
def velocity(spark, d):
    return op.velocity(events(spark, d), "user_id", "ts").withColumn("p50", F.round("p50", 6)).withColumn("p90", F.round("p90", 6))


@query(
    """, dated AS (SELECT id AS work_id, month(update_date)::INT AS month, year(update_date) AS year FROM works WHERE update_date IS NOT NULL),
    t AS (SELECT tag, month, year FROM carried JOIN dated USING (work_id)), am AS (SELECT month, count(*) AS all_month FROM dated GROUP BY 1),
    per AS (SELECT tag, month, works, sum(works) OVER (PARTITION BY tag) AS support FROM (SELECT tag, month, count(*) AS works FROM t GROUP BY 1, 2)),
    l AS (SELECT tag, month, works, support::BIGINT AS support, (works / support) / (all_month / (SELECT count(*) FROM dated)) AS lift FROM per JOIN am USING (month) WHERE support >= 20),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY round(lift, 9) DESC, month) AS rn FROM l) WHERE rn = 1),
    peak AS (SELECT tag, month AS peak FROM (SELECT tag, year, month, row_number() OVER (PARTITION BY tag, year ORDER BY count(*) DESC, month) AS rn FROM t GROUP BY 1, 2, 3) WHERE rn = 1)
    SELECT tag, month, round(any_value(lift), 6) AS lift, any_value(works) AS works, any_value(support) AS support, count(*) AS years, round(avg((peak = month)::INT), 6) AS year_share FROM best JOIN peak USING (tag) GROUP BY 1, 2""",
    "carried works",
)
def seasons(spark, d):
    r = catalog(spark, d)
    return op.seasons(r.works, r.work_tags, 20).select("tag", "month", F.round("lift", 6).alias("lift"), "works", "support", "years", F.round("year_share", 6).alias("year_share"))


@query("SELECT authors, round(avg(kudos), 6) AS mean_score, count(*) AS n FROM (SELECT authors, kudos, row_number() OVER (PARTITION BY authors ORDER BY kudos DESC, id) AS rn FROM works) WHERE rn <= 5 GROUP BY 1", "works")
def shelf_fandom_rank(spark, d):
    return op.top_per_group_mean(catalog(spark, d).works, "authors", "kudos", "id", 5).select("authors", F.round("mean_score", 6).alias("mean_score"), "n")


@query(
    """, h AS (SELECT authors AS brand, tag, count(*) AS here FROM carried JOIN works ON id = work_id GROUP BY 1, 2 HAVING count(*) >= 3 AND tag <> authors),
    z AS (SELECT authors AS brand, count(*) AS size FROM works GROUP BY 1), l AS (SELECT brand, tag, here, round(here * n / (size * df.df), 9) AS lift FROM h JOIN z USING (brand) JOIN df USING (tag), total)
    SELECT brand, tag, here, round(lift, 6) AS lift, rank FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY lift DESC, tag) AS rank FROM l) WHERE rank <= 3""",
    "carried works df total",
)
def why_lines(spark, d):
    r = catalog(spark, d)
    return op.why_lines(r.works, r.work_tags, 3).withColumn("lift", F.round("lift", 6))


@query(
    """, r AS (SELECT rank() OVER (ORDER BY kudos) + (count(*) OVER (PARTITION BY kudos) - 1) / 2 AS rx, rank() OVER (ORDER BY hits) + (count(*) OVER (PARTITION BY hits) - 1) / 2 AS ry FROM works)
    SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r""",
    "works",
)
def spearman(spark, d):
    return op.spearman(catalog(spark, d).works, "kudos", "hits").select(F.round("rho", 6).alias("rho"), "n")


@query(
    """SELECT a.authors, round(sum(sign(a.kudos - b.kudos) * sign(a.hits - b.hits)) / count(*) FILTER (sign(a.kudos - b.kudos) * sign(a.hits - b.hits) <> 0), 6) AS tau, count(*) FILTER (sign(a.kudos - b.kudos) * sign(a.hits - b.hits) <> 0) AS decided
    FROM works a JOIN works b ON a.authors = b.authors AND a.id < b.id GROUP BY 1""",
    "works",
)
def kendall(spark, d):
    return op.kendall(catalog(spark, d).works, "id", "kudos", "hits", "authors").withColumn("tau", F.round("tau", 6))


@query("SELECT tag, count(*) AS works FROM carried WHERE work_id IN (SELECT id FROM works WHERE authors = 'Brand#11' AND rating = (SELECT min(rating) FROM works WHERE authors = 'Brand#11')) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM works WHERE authors = 'Brand#11' AND rating = (SELECT min(rating) FROM works WHERE authors = 'Brand#11'))", "carried works")
def passed_over_tags(spark, d):
    r = catalog(spark, d)
    own = r.works.where("authors = 'Brand#11'")
    lost = own.join(F.broadcast(own.agg(F.min("rating").alias("rating"))), "rating").select(F.col("id").alias("work_id"))
    return op.passed_over(lost, r.work_tags)


@query("SELECT work_id, tag, df, rank FROM (SELECT work_id, tag, df.df AS df, row_number() OVER (PARTITION BY work_id ORDER BY df.df, tag) AS rank FROM carried JOIN df USING (tag), total WHERE df.df < n) WHERE rank <= 3", "carried df total")
def distinctive_tags(spark, d):
    r = catalog(spark, d)
    return op.distinctive(r.work_tags, r.works, 3)


@query("SELECT id, kudos FROM works ORDER BY kudos DESC, id LIMIT 50", "works")
def top_by_kudos(spark, d):
    return op.top_by(catalog(spark, d).works, "kudos", 50).select("id", "kudos")


@query("SELECT id, update_date FROM works ORDER BY update_date DESC NULLS LAST, id LIMIT 50", "works")
def chronological_listing(spark, d):
    return op.newest(catalog(spark, d).works, 50).select("id", "update_date")


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


NEAR = """, q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 9) AS sim FROM embeddings, q WHERE vec_id <> query_id)
    SELECT query_id, id, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s WHERE sim >= 0.1) WHERE rank <= 10"""


@query("WITH" + NEAR[1:])
def nearest_vectors(spark, d):
    v = vectors(spark, d)
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    return op.nearest(v, q, 10, 0.1).withColumn("sim", F.round(F.col("sim") * 1e6) / 1e6)  # as DuckDB rounds: of doubles, not of their decimals


POOLS = """, s0 AS (SELECT id, row_number() OVER (ORDER BY kudos DESC, id) AS pos, 0 AS source FROM works ORDER BY kudos DESC, id LIMIT 40),
    s1 AS (SELECT id, row_number() OVER (ORDER BY hits DESC, id) AS pos, 1 AS source FROM works ORDER BY hits DESC, id LIMIT 40),
    s2 AS (SELECT id, row_number() OVER (ORDER BY word_count DESC, id) AS pos, 2 AS source FROM works ORDER BY word_count DESC, id LIMIT 40),
    u AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2),
    f AS (SELECT id, min(source) AS source, arg_min(pos, source) AS pos, count(*) - 1 AS overlap FROM u GROUP BY 1)
    SELECT id, source, pos::INT AS pos, overlap, row_number() OVER (ORDER BY source, pos, id) AS place FROM f ORDER BY source, pos, id LIMIT 60"""


@query(POOLS, "works")
def pool_union_admission(spark, d):
    w = catalog(spark, d).works
    from pyspark.sql import Window as W

    pools = [op.top_by(w, c, 40).withColumn("pos", F.row_number().over(W.orderBy(F.desc(c), "id"))) for c in ("kudos", "hits", "word_count")]
    return op.admit(pools, 60)


@query(
    """, p AS (SELECT a, b, co, x.df AS na, y.df AS nb FROM pairs JOIN df x ON x.tag = a JOIN df y ON y.tag = b)
    SELECT CASE WHEN na < nb OR (na = nb AND a > b) THEN a ELSE b END AS small, CASE WHEN na < nb OR (na = nb AND a > b) THEN b ELSE a END AS large, round(co / least(na, nb), 6) AS overlap FROM p WHERE co / least(na, nb) > 0.2 AND least(na, nb) / greatest(na, nb) >= 0.1""",
    "pairs df",
)
def variant_overlap(spark, d):
    return op.overlaps(catalog(spark, d).work_tags, 0.2, 0.1).withColumn("overlap", F.round("overlap", 6))


@query("SELECT id, (id * 48271 + 11) % 2147483647 AS h FROM works ORDER BY h, id LIMIT 25", "works")
def hash_sample(spark, d):
    return op.hash_sample(catalog(spark, d).works, "id", 25).select("id", "h")

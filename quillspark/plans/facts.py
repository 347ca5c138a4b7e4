"""Queries over edges, names, addresses, works' facts, stored relations and verdicts, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.operators import corpus as op
from quillspark.operators import facts as fc
from quillspark.plans.corpus import events, vectors
from quillspark.plans.registry import query
from quillspark.plans.state import LOG, PROF, log, rounded, weights
from quillspark.sources import sidecar
from quillspark.sources.staging import folder
from quillspark.sources.tables import catalog, table


def _kept(df, kind: str, total: float = 0.0):
    """df stored beside the corpus and read back with its checks."""
    path = f"{folder(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    sidecar.save(df, path, kind, total)
    return sidecar.load(df.sparkSession, path, kind)


@query("SELECT tag, df, n FROM df, total", "df total")
def stored_frequencies(spark, d):
    r = catalog(spark, d)
    rows, total = _kept(op.doc_frequency(r.work_tags).select("tag", "df"), "frequencies", r.works.count())
    return rows.withColumn("n", F.lit(int(total)).cast("long"))


@query("SELECT src, dst, co FROM sym", "sym")
def stored_graph(spark, d):
    return _kept(op.symmetric(op.tag_pairs(catalog(spark, d).work_tags)).select("src", "dst", "co"), "edges")[0]


@query("SELECT vec_id AS id, len(embedding) AS width FROM embeddings")
def stored_factors(spark, d):
    rows, _ = _kept(vectors(spark, d).select("id", "v"), "factors")
    return sidecar.of_one_width(rows).select("id", F.size("v").cast("long").alias("width"))


@query(
    LOG + """, al AS (SELECT least(a, b) AS a, greatest(a, b) AS b, CASE WHEN kind = 'k0' THEN 0 ELSE 1 END AS late, key, key % 7 AS weight FROM lg)
    SELECT a, b, weight FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY late DESC, key DESC) AS rn FROM al) WHERE rn = 1""",
    "evt",
)
def edges_upsert(spark, d):
    e = log(spark, d).select("kind", "a", "b", "key", (F.col("key") % 7).alias("weight"))
    return fc.upserted_edges(e.where("kind = 'k0'"), e.where("kind <> 'k0'"))


@query(
    """, e AS (SELECT k AS src, user_id % 100 AS dst, min(event_id % 3) AS weight FROM evt GROUP BY 1, 2), s AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) FILTER (src < dst) AS up, count(*) FILTER (src > dst) AS down, min(weight) AS lo, max(weight) AS hi FROM e WHERE src <> dst GROUP BY 1, 2)
    SELECT 'unknown node' AS fault, (SELECT count(*) FROM e WHERE src > 97) + (SELECT count(*) FROM e WHERE dst > 97) AS n UNION ALL SELECT 'loop', count(*) FROM e WHERE src = dst UNION ALL SELECT 'no weight', count(*) FROM e WHERE weight <= 0
    UNION ALL SELECT 'one way', count(*) FROM s WHERE up = 0 OR down = 0 UNION ALL SELECT 'repeated', count(*) FROM s WHERE up > 1 OR down > 1 UNION ALL SELECT 'unequal weights', count(*) FROM s WHERE up > 0 AND down > 0 AND lo <> hi""",
    "evt",
)
def graph_faults(spark, d):
    e = events(spark, d).groupBy(F.col("k").alias("src"), (F.col("user_id") % 100).alias("dst")).agg(F.min(F.col("event_id") % 3).alias("weight"))
    return fc.graph_faults(spark.range(98), e)


@query("SELECT tag, df FROM df ORDER BY df DESC, tag LIMIT 12", "df")
def trimmed_mass(spark, d):
    return fc.trimmed(op.doc_frequency(catalog(spark, d).work_tags).select("tag", "df"), 12, "tag", "df")


@query(PROF + " SELECT p.owner, count(*) AS shared, round(sum(least(p.weight, l.weight)), 6) AS weight FROM prof p JOIN lrn l ON p.owner = l.owner AND p.tag = l.tag GROUP BY 1", "evt")
def shared_weight(spark, d):
    return rounded(fc.shared_weight(*weights(spark, d), ["owner"]), "weight")


PAIRED = "n AS (SELECT p_partkey AS id, list_distinct(string_split(lower(p_name), ' ') || [lower(p_brand), lower(p_type)]) AS x FROM part)"


@query(
    f"WITH {PAIRED} SELECT a.id, round(len(list_intersect(a.x, b.x)) / len(list_distinct(a.x || b.x)), 6) AS overlap FROM n a JOIN n b ON b.id = a.id + 1"
)
def name_jaccard(spark, d):
    p = table(spark, d, "part")
    x = F.concat(F.split("p_name", " "), F.array("p_brand", "p_type"))
    after = p.select((F.col("p_partkey") - 1).alias("id"), F.transform(x, F.upper).alias("y"))
    return p.select(F.col("p_partkey").alias("id"), x.alias("x")).join(after, "id").select("id", F.round(fc.name_jaccard(F.col("x"), F.col("y")), 6).alias("overlap"))


@query(
    """, t AS (SELECT work_id, list(tag ORDER BY df, tag) AS tags FROM carried JOIN df USING (tag) GROUP BY 1)
    SELECT a.work_id, array_to_string(list_filter(b.tags, lambda x: list_contains(a.tags, x))[1:3], ',') AS shared FROM t a JOIN t b ON b.work_id = a.work_id + 1""",
    "carried df",
)
def shared_names(spark, d):
    t = fc.rarest_first(catalog(spark, d).work_tags)
    after = t.select((F.col("work_id") - 1).alias("work_id"), F.col("tags").alias("after"))
    return t.join(after, "work_id").select("work_id", F.concat_ws(",", fc.shared_names(F.col("tags"), F.col("after"))).alias("shared"))


#: One address of each shape, and what it lists.
ADDRESSES = [
    ("/tags/{}/works", "tag"), ("https://host.example/tags/{}", "tag"), ("/tags", ""), ("/works?q={}", "search"), ("/works", ""), ("/users/{}/works/", "user-works"), ("https://host.example/users/{}/pseuds/b/bookmarks?page=2", "user-bookmarks"),
    ("/users/{}", ""), ("/collections/{}/works", "collection"), ("/series/{}", "series"), ("/series/new", ""), ("/{}", ""),
]


@query("SELECT p_partkey AS id, ([" + ", ".join(f"'{kind}'" for _, kind in ADDRESSES) + f"])[p_partkey % {len(ADDRESSES)} + 1] AS kind FROM part")
def listing_kinds(spark, d):
    shape = F.array(*(F.lit(a) for a, _ in ADDRESSES))[(F.col("p_partkey") % len(ADDRESSES)).cast("int")]
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), fc.listing_kind(F.replace(shape, F.lit("{}"), F.col("p_partkey").cast("string"))).alias("kind"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 2 THEN event_type END AS kind, CASE WHEN event_id % 4 < 2 THEN k END AS id FROM evt", "evt")
def parsed_seeds(spark, d):
    k, t, n = F.col("k").cast("string"), F.col("event_type"), F.col("event_id") % 4
    said = F.when(n == 0, F.concat_ws(":", t, k)).when(n == 1, F.concat(F.lit(" "), t, F.lit(":"), k, F.lit("\n"))).when(n == 2, F.concat(t, F.lit(": "), k)).otherwise(F.concat(F.lit(":"), k))
    return events(spark, d).select("event_id", fc.seed_of(said).alias("s")).select("event_id", "s.kind", "s.id")


@query("SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'General Audiences' WHEN 1 THEN 'Teen And Up Audiences' WHEN 2 THEN 'Mature' WHEN 3 THEN 'Explicit' WHEN 4 THEN 'Z' ELSE 'Not Rated' END AS rating FROM part")
def stored_ratings(spark, d):
    said = F.array(*(F.lit(x) for x in ("g", " T ", "M", "e", "Z", "Not Rated")))[F.col("p_size") % 6]
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), fc.stored_rating(said).alias("rating"))


@query(
    """, t AS (SELECT work_id, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM work_tags GROUP BY 1)
    SELECT id, title, authors, word_count, rating, kudos, hits, bookmarks, complete, language, tags FROM works LEFT JOIN t ON work_id = id WHERE id IN (SELECT k FROM evt)""",
    "works work_tags evt",
)
def work_lookup(spark, d):
    r = catalog(spark, d)
    found = fc.lookup(r.works, r.work_tags, events(spark, d).select(F.col("k").alias("id")))
    return found.drop("update_date").withColumn("tags", F.array_join("tags", ","))


@query(
    """, s AS (SELECT id, unnest(['kudos', 'hits', 'word_count', 'complete', 'has_bookmarks', 'bookmarks', 'update_date', 'language_' || language]) AS name,
    unnest([kudos::DOUBLE, hits, word_count, complete::INT, (bookmarks IS NOT NULL)::INT, bookmarks, date_diff('day', DATE '1970-01-01', update_date), 1]) AS value FROM works) SELECT * FROM s WHERE value IS NOT NULL""",
    "works",
)
def work_stats(spark, d):
    return fc.stats_of(catalog(spark, d).works).select("id", F.explode("stats").alias("name", "value"))


@query("SELECT id, word_count FROM works WHERE word_count > 0 AND id IN (SELECT user_id FROM evt)", "works evt")
def known_lengths(spark, d):
    return fc.known_lengths(catalog(spark, d).works, events(spark, d).select(F.col("user_id").alias("id")))


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 5) AS norm FROM embeddings WHERE len(embedding) = 64")
def vector_norms(spark, d):
    return fc.vector_norms(vectors(spark, d), 64).select("id", F.round("norm", 5).alias("norm"))


@query("SELECT count(*) FILTER (vec_id % 9 <> 0) AS read, count(*) FILTER (vec_id % 9 = 0) AS skipped FROM embeddings")
def vector_counts(spark, d):
    v = vectors(spark, d).select(F.when(F.col("id") % 9 == 0, F.slice("v", 1, 8)).otherwise(F.col("v")).alias("v"))
    return fc.vector_counts(v, 64)


@query(
    """WITH e AS (SELECT vec_id AS id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings), c AS (SELECT label, p, avg(x) AS c FROM e GROUP BY 1, 2), z AS (SELECT label, sqrt(sum(c * c)) AS nc FROM c GROUP BY 1),
    d AS (SELECT id, c.label = e.label AS own, sum(x * c) AS dot, sqrt(sum(x * x)) AS n, max(nc) AS nc FROM e JOIN c ON c.p = e.p AND c.label IN (e.label, (e.label + 1) % 10) JOIN z ON z.label = c.label GROUP BY 1, 2)
    SELECT round(avg(dot / (n * nc)) FILTER (own), 5) AS own, round(avg(dot / (n * nc)) FILTER (NOT own), 5) AS other FROM d"""
)
def family_coherence(spark, d):
    members = vectors(spark, d).select("id", F.col("label").alias("family"), "v")
    return fc.coherence(members, 10).select(F.round("own", 5).alias("own"), F.round("other", 5).alias("other"))


@query(
    """, v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT round(sqrt(avg(power(41 * (1 - list_dot_product(x.v, y.v)), 2))), 4) AS rmse FROM evt JOIN v x ON x.vec_id = user_id JOIN v y ON y.vec_id = k""",
    "evt",
)
def observed_rmse(spark, d):
    v = vectors(spark, d).select("id", "v")
    return fc.observed_rmse(events(spark, d).select("user_id", F.col("k").alias("work_id")), v, v, 40.0).select(F.round("rmse", 4).alias("rmse"))


@query(
    """, n AS (SELECT count(*) FILTER (event_type = 'view') AS t, count(*) FILTER (event_type = 'click') AS r, count(*) FILTER (event_type = 'error') AS z FROM evt), s AS (SELECT 'tags' AS kind, t AS wins, r AS losses, z AS ties FROM n UNION ALL SELECT 'readers', r, t, z FROM n),
    q AS (SELECT kind, least(1.0, 2 * sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2)))) AS p FROM (SELECT *, unnest(range(least(wins, losses) + 1)) AS i FROM s) GROUP BY 1)
    SELECT kind, wins, losses, ties, wins + losses + ties AS judged, round(p, 5) AS p, CASE WHEN wins + losses < 10 THEN 'too few' WHEN p > 0.05 THEN 'level' WHEN wins > losses THEN 'leads' ELSE 'behind' END AS verdict FROM s JOIN q USING (kind)""",
    "evt",
)
def explanation_standings(spark, d):
    winner = F.when(F.col("event_type") == "view", "tags").when(F.col("event_type") == "click", "readers").when(F.col("event_type") == "error", "neither")
    return fc.explanation_standings(events(spark, d).select(winner.alias("winner"))).withColumn("p", F.round("p", 5))


@query(
    """, p AS (SELECT k AS tag, avg(value) - 50 AS mean_dev, avg(user_id % 7 - 3) AS signed, count(*) AS n FROM evt GROUP BY 1), s AS (SELECT *, CASE WHEN mean_dev * signed > 0 THEN 'predictor' WHEN mean_dev * signed < 0 THEN 'anti-predictor' END AS side FROM p)
    SELECT side, tag, round(mean_dev, 5) AS mean_dev, round(signed, 5) AS signed, n, place FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY round(abs(mean_dev * signed), 9) DESC, tag) AS place FROM s WHERE side IS NOT NULL) WHERE place <= 8""",
    "evt",
)
def predictor_tags(spark, d):
    f = events(spark, d).select(F.col("k").alias("tag"), (F.col("value") - 50).alias("dev"), (F.col("user_id") % 7 - 3).alias("weight"))
    return fc.predictors(f).select("side", "tag", F.round("mean_dev", 5).alias("mean_dev"), F.round("signed", 5).alias("signed"), "n", "place")

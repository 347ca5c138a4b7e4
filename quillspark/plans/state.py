"""Queries over readers' state, the arena's log and the crawl's queue, bound to the events table, with their SQL twins."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import state as st
from quillspark.plans.corpus import events
from quillspark.plans.registry import query
from quillspark.sources.tables import catalog

SINCE = datetime.datetime(2024, 1, 20)
PROF = ", prof AS (SELECT user_id AS owner, k % 30 AS tag, avg(value) - 50 AS weight FROM evt WHERE event_type IN ('view', 'click') GROUP BY 1, 2), lrn AS (SELECT user_id AS owner, k % 25 AS tag, avg(value) - 40 AS weight FROM evt WHERE event_type = 'purchase' GROUP BY 1, 2)"
VEC = PROF + """, un AS (SELECT owner, tag, weight / sqrt(sum(weight * weight) OVER (PARTITION BY owner)) AS weight FROM prof UNION ALL SELECT owner, tag, weight / sqrt(sum(weight * weight) OVER (PARTITION BY owner)) FROM lrn),
    vec AS (SELECT owner, tag, sum(weight) / 2 AS weight FROM un GROUP BY 1, 2)"""
LOG = ", lg AS (SELECT event_id AS key, user_id AS owner, 'k' || event_id % 3 AS kind, k AS a, (k * 7 + 3) % 100 AS b, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'error' THEN 'neither' WHEN value > 50 THEN 'a' ELSE 'b' END AS choice, ts AS judged_at FROM evt WHERE k <> (k * 7 + 3) % 100)"
MARKS = ", st AS (SELECT user_id AS owner, k AS work, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS polarity, ts AS marked, event_id AS key FROM evt WHERE event_type IN ('click', 'error'))"
QUEUE = ", qu AS (SELECT 'u' || event_id AS url, CASE event_type WHEN 'view' THEN 'taken' WHEN 'click' THEN 'done' ELSE 'pending' END AS state, ts AS taken_at, k % 7 AS attempts FROM evt)"


def weights(spark, d) -> tuple[DataFrame, DataFrame]:
    e = events(spark, d)
    of = lambda rows, n, mid: rows.groupBy(F.col("user_id").alias("owner"), (F.col("k") % n).alias("tag")).agg((F.avg("value") - mid).alias("weight"))
    return of(e.where("event_type in ('view', 'click')"), 30, 50), of(e.where("event_type = 'purchase'"), 25, 40)


def vectors(spark, d) -> DataFrame:
    return st.owner_vector(*weights(spark, d))


def log(spark, d) -> DataFrame:
    e, other = events(spark, d), (F.col("k") * 7 + 3) % 100
    choice = F.when(F.col("event_type") == "view", None).when(F.col("event_type") == "error", "neither").when(F.col("value") > 50, "a").otherwise("b")
    rows = e.select(F.col("event_id").alias("key"), F.col("user_id").alias("owner"), F.concat(F.lit("k"), F.col("event_id") % 3).alias("kind"), F.col("k").alias("a"), other.alias("b"), choice.alias("choice"), F.col("ts").alias("judged_at"))
    return rows.where("a <> b")


def stances(spark, d) -> DataFrame:
    e = events(spark, d).where("event_type in ('click', 'error')")
    return e.select(F.col("user_id").alias("owner"), F.col("k").alias("work"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("polarity"), F.col("ts").alias("at"), F.col("event_id").alias("key"))


def queue(spark, d) -> DataFrame:
    state = F.when(F.col("event_type") == "view", "taken").when(F.col("event_type") == "click", "done").otherwise("pending")
    return events(spark, d).select(F.concat(F.lit("u"), F.col("event_id")).alias("url"), state.alias("state"), F.col("ts").alias("taken_at"), (F.col("k") % 7).alias("attempts"))


def rounded(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.round(c, 6))


@query(VEC + " SELECT owner, tag, round(weight, 6) AS weight FROM vec", "evt")
def owner_vector(spark, d):
    return rounded(vectors(spark, d), "weight")


@query(
    VEC + """, n AS (SELECT owner, sqrt(sum(weight * weight)) AS n FROM vec GROUP BY 1), me AS (SELECT tag, weight FROM vec WHERE owner = 1), dt AS (SELECT v.owner, sum(v.weight * me.weight) AS dot FROM vec v JOIN me USING (tag) GROUP BY 1)
    SELECT o.user_id AS voter, round(CASE WHEN o.user_id = 1 THEN 1.0 ELSE coalesce(dot / (n * (SELECT n FROM n WHERE owner = 1)), 0) END, 6) AS agree FROM (SELECT DISTINCT user_id FROM evt) o LEFT JOIN n ON n.owner = o.user_id LEFT JOIN dt ON dt.owner = o.user_id""",
    "evt",
)
def agreement_policy(spark, d):
    voters = events(spark, d).select(F.col("user_id").alias("voter")).distinct()
    return rounded(st.agreement_with(vectors(spark, d), voters, 1), "agree")


@query(PROF + " SELECT owner, tag, round(weight, 6) AS weight, place FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY round(abs(weight), 9) DESC, tag) AS place FROM prof) WHERE place <= 12", "evt")
def top_weights(spark, d):
    return rounded(st.top_weights(weights(spark, d)[0], 12), "weight")


@query(PROF + " SELECT owner, side, tag, place FROM (SELECT owner, tag, CASE WHEN weight > 0 THEN 'liked' ELSE 'disliked' END AS side, row_number() OVER (PARTITION BY owner, weight > 0 ORDER BY round(abs(weight), 9) DESC, tag) AS place FROM prof WHERE weight <> 0) WHERE place <= 5", "evt")
def liked_and_disliked(spark, d):
    return st.liked_and_disliked(weights(spark, d)[0], 5)


@query(PROF + " SELECT coalesce(p.owner, l.owner) AS owner, coalesce(p.tag, l.tag) AS tag, round(coalesce(l.weight, p.weight), 6) AS weight FROM prof p FULL JOIN lrn l ON p.owner = l.owner AND p.tag = l.tag", "evt")
def taste_import(spark, d):
    return rounded(st.import_taste(*weights(spark, d)), "weight")


@query(PROF + " SELECT owner, tag, round(weight, 6) AS weight FROM prof WHERE owner NOT IN (SELECT owner FROM lrn) UNION ALL SELECT owner, tag, round(weight, 6) FROM lrn", "evt")
def taste_replace(spark, d):
    return rounded(st.import_taste(*weights(spark, d), replace=True), "weight")


@query(PROF + MARKS + " SELECT 'weights' AS rel, owner, count(*) AS n FROM prof WHERE owner % 2 = 1 GROUP BY ALL UNION ALL SELECT 'stances', owner, count(*) FROM st WHERE owner % 2 = 1 GROUP BY ALL", "evt")
def forget_readers(spark, d):
    gone = events(spark, d).where("user_id % 2 = 0").select(F.col("user_id").alias("owner"))
    w, s = st.forget(gone, weights(spark, d)[0], stances(spark, d))
    count = lambda t, n: t.groupBy(F.lit(n).alias("rel"), "owner").agg(F.count("*").alias("n"))
    return count(w, "weights").union(count(s, "stances"))


@query(", l AS (SELECT user_id AS owner, k % 20 AS tag, event_type, row_number() OVER (PARTITION BY user_id, k % 20 ORDER BY ts DESC, event_id DESC) AS rn FROM evt WHERE event_type IN ('error', 'view')) SELECT owner, tag FROM l WHERE rn = 1 AND event_type = 'error'", "evt")
def blocked_tags_now(spark, d):
    e = events(spark, d).where("event_type in ('error', 'view')")
    return st.blocked_now(e.select(F.col("user_id").alias("owner"), (F.col("k") % 20).alias("tag"), F.when(F.col("event_type") == "error", "block").otherwise("unblock").alias("action"), F.col("ts").alias("at"), F.col("event_id").alias("key")))


@query(MARKS + ", n AS (SELECT *, row_number() OVER (PARTITION BY owner, work ORDER BY marked DESC, key DESC) AS rn FROM st) SELECT owner, count(*) FILTER (polarity > 0) AS likes, count(*) FILTER (polarity < 0) AS dislikes FROM n WHERE rn = 1 GROUP BY 1", "evt")
def stance_counts(spark, d):
    return st.stance_counts(stances(spark, d))


@query(MARKS + " SELECT key, round(greatest(-1.0, least(1.0, 3.0 * polarity / sqrt(1 + work % 12))), 6) AS delta FROM st", "evt")
def feedback_delta(spark, d):
    return stances(spark, d).select("key", F.round(st.feedback_delta(F.lit(3.0), F.col("polarity"), 1 + F.col("work") % 12), 6).alias("delta"))


@query(LOG + " SELECT key, least(a, b) AS low, greatest(a, b) AS high, CASE WHEN a > b AND choice = 'a' THEN 'b' WHEN a > b AND choice = 'b' THEN 'a' ELSE choice END AS choice FROM lg", "evt")
def canonical_pairs(spark, d):
    return st.canonical_pairs(log(spark, d)).select("key", "low", "high", "choice")


@query(LOG + " SELECT DISTINCT owner, least(a, b) AS low, greatest(a, b) AS high FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY key DESC) AS rn FROM lg) WHERE rn <= 4000", "evt")
def seen_pairs(spark, d):
    return st.seen_pairs(log(spark, d))


@query(LOG + " SELECT count(*) AS shown, count(*) FILTER (choice IN ('a', 'b')) AS judged, count(*) FILTER (choice = 'neither') AS neither, count(*) FILTER (choice IS NULL) AS open FROM lg", "evt")
def arena_stats(spark, d):
    return st.arena_stats(log(spark, d))


@query(LOG + " SELECT owner, kind, key FROM (SELECT *, row_number() OVER (PARTITION BY owner, kind ORDER BY key DESC) AS rn FROM lg) WHERE rn = 1 AND choice IS NULL", "evt")
def latest_open_pair(spark, d):
    return st.latest_open(log(spark, d))


@query(LOG + " SELECT key, choice FROM lg WHERE judged_at > TIMESTAMP '2024-01-20' AND choice IS NOT NULL ORDER BY key LIMIT 20000", "evt")
def judged_after(spark, d):
    return st.judged_after(log(spark, d), SINCE).select("key", "choice")


@query(LOG + " SELECT owner, CASE choice WHEN 'a' THEN b ELSE a END AS work FROM lg WHERE choice IN ('a', 'b') UNION ALL SELECT owner, a FROM lg WHERE choice = 'neither' UNION ALL SELECT owner, b FROM lg WHERE choice = 'neither'", "evt")
def rejected_works(spark, d):
    return st.rejected(log(spark, d))


@query(LOG + " SELECT owner, key, row_number() OVER (PARTITION BY owner ORDER BY key) AS place FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY key DESC) AS rn FROM lg) WHERE rn <= 20", "evt")
def rating_history(spark, d):
    return st.history(log(spark, d), "owner", "key", 20).select("owner", "key", "place")


@query(
    VEC + LOG + """, n AS (SELECT owner, sqrt(sum(weight * weight)) AS n FROM vec GROUP BY 1), me AS (SELECT tag, weight FROM vec WHERE owner = 1), dt AS (SELECT v.owner, sum(v.weight * me.weight) AS dot FROM vec v JOIN me USING (tag) GROUP BY 1)
    SELECT key, round(CASE WHEN lg.owner = 1 THEN 1.0 ELSE coalesce(dot / (n * (SELECT n FROM n WHERE owner = 1)), 0) END, 6) AS agree FROM lg LEFT JOIN n USING (owner) LEFT JOIN dt USING (owner) WHERE choice IS NOT NULL""",
    "evt",
)
def judgement_stamps(spark, d):
    j = log(spark, d).where("choice is not null").withColumnRenamed("owner", "voter")
    agree = st.agreement_with(vectors(spark, d), j.select("voter").distinct(), 1)
    return st.stamped(j, agree).select("key", F.round("agree", 6).alias("agree"))


@query(QUEUE + " SELECT url, CASE WHEN state = 'taken' AND taken_at < TIMESTAMP '2024-01-20' THEN 'pending' ELSE state END AS state, CASE WHEN state = 'taken' AND taken_at < TIMESTAMP '2024-01-20' THEN NULL ELSE taken_at END AS taken_at FROM qu", "evt")
def requeue_stale(spark, d):
    return st.requeued(queue(spark, d), SINCE).select("url", "state", "taken_at")


@query(QUEUE + " SELECT url, CASE WHEN state <> 'done' AND attempts >= 5 THEN 'parked' ELSE state END AS state FROM qu", "evt")
def queue_parked(spark, d):
    return st.parked(queue(spark, d), 5).select("url", "state")


@query(MARKS + " SELECT owner, count(*) AS marks FROM st WHERE marked > TIMESTAMP '2024-01-20' GROUP BY 1", "evt")
def marks_since(spark, d):
    return st.marks_since(stances(spark, d), SINCE)


@query(MARKS + " SELECT DISTINCT owner, work FROM st WHERE work IN (SELECT id FROM works)", "evt works")
def read_among(spark, d):
    return st.read_among(stances(spark, d), catalog(spark, d).works.select(F.col("id").alias("work")))


@query(LOG + ", r AS (SELECT kind, max(judged_at) AS last FROM lg WHERE kind <> 'k2' GROUP BY 1) SELECT kind FROM (VALUES ('k0'), ('k1'), ('k2'), ('k3')) v(kind) LEFT JOIN r USING (kind) WHERE last IS NULL OR TIMESTAMP '2024-01-31' - last > INTERVAL 1 DAY", "evt")
def candidates_due(spark, d):
    drawn = log(spark, d).where("kind <> 'k2'").select("kind", F.col("judged_at").alias("at"))
    return st.due(drawn, spark.createDataFrame([(f"k{i}",) for i in range(4)], "kind string"), datetime.datetime(2024, 1, 31), 86400)


@query(LOG + " SELECT kind, a AS id, count(*) AS n FROM lg WHERE kind <> 'k1' GROUP BY ALL UNION ALL SELECT 'k1', id, 0 FROM works WHERE kudos > 100", "evt works")
def candidates_replaced(spark, d):
    stored = log(spark, d).groupBy("kind", F.col("a").alias("id")).agg(F.count("*").alias("n"))
    new = catalog(spark, d).works.where("kudos > 100").select(F.lit("k1").alias("kind"), "id", F.lit(0).cast("long").alias("n"))
    return st.replaced(stored, new, spark.createDataFrame([("k1",)], "kind string"))


@query(", r AS (SELECT event_id // 100 AS run, k AS position, value FROM evt) SELECT run, position, round(value, 4) AS value FROM r WHERE run = (SELECT max(run) FROM r)", "evt")
def latest_calibration(spark, d):
    rows = events(spark, d).select(F.floor(F.col("event_id") / 100).alias("run"), F.col("k").alias("position"), "value")
    return st.latest_run(rows, "run").select("run", "position", F.round("value", 4).alias("value"))


@query(" SELECT DISTINCT user_id, k AS work FROM evt", "evt")
def bookmark_import(spark, d):
    e = events(spark, d)
    rows = lambda t: e.where(F.col("event_type") == t).select("user_id", F.col("k").alias("work"))
    out = rows("view").distinct()
    for t in ("click", "purchase", "signup", "error"):
        out = st.imported(out, rows(t), ["user_id", "work"])
    return out


@query("SELECT max(coalesce(CASE WHEN id % 3 = 0 THEN update_date END, DATE '1999-01-01' + id::INT % 500)) AS stamp FROM works", "works")
def corpus_stamp(spark, d):
    w = catalog(spark, d).works.select(F.when(F.col("id") % 3 == 0, F.col("update_date")).alias("u"), F.date_add(F.lit("1999-01-01").cast("date"), (F.col("id") % 500).cast("int")).alias("s"))
    return st.stamp(w, "u", "s")


@query("SELECT tag_type AS name, least(max(n), 40) AS quota FROM (SELECT tag_type, tag, count(*) AS n FROM work_tags GROUP BY 1, 2) GROUP BY 1", "work_tags")
def flat_quota(spark, d):
    t = catalog(spark, d).work_tags.groupBy(F.col("tag_type").alias("name"), "tag").agg(F.count("*").alias("works"))
    return st.quota(t, 40)

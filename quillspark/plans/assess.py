"""Queries over rating periods, held-out checks, credit by seed, snapshots and parsed pages, with their SQL twins."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.operators import assess as sm
from quillspark.operators import corpus as op
from quillspark.operators import events as ev
from quillspark.plans.corpus import events
from quillspark.plans.experiments import HELD, RECS, holdout, popularity_lists
from quillspark.plans.registry import query
from quillspark.plans.state import LOG, QUEUE, SINCE, log, queue
from quillspark.sources import html as ht
from quillspark.sources import paste
from quillspark.sources.tables import catalog, table


def six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# -- rating periods: judged pairs of three kinds, one of them never rated before ------------------------------------------

JUDGED = LOG + """, jd AS (SELECT kind, judged_at AS judged, CASE choice WHEN 'b' THEN b ELSE a END AS winner, CASE choice WHEN 'b' THEN a ELSE b END AS loser, CASE choice WHEN 'neither' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS score, (key % 11) / 10 AS agreement FROM lg WHERE choice IS NOT NULL),
    nj AS (SELECT *, agreement * agreement AS weight FROM jd WHERE CASE kind WHEN 'k0' THEN judged > TIMESTAMP '2024-01-20' WHEN 'k1' THEN judged > TIMESTAMP '2024-01-05' ELSE true END),
    oc AS (SELECT kind, winner AS entity, loser AS opponent, score, weight FROM nj WHERE weight >= 0.05 UNION ALL SELECT kind, loser, winner, 1 - score, weight FROM nj WHERE weight >= 0.05 AND score <> 0.5)"""
BEFORE = """, bf AS (SELECT DISTINCT kind, e AS entity, CASE WHEN e % 3 <> 0 THEN 1500.0::DOUBLE + e % 7 * 20 ELSE 1500 END AS mu, CASE WHEN e % 3 <> 0 THEN 200.0::DOUBLE + e % 5 * 10 ELSE 350 END AS phi FROM (SELECT kind, winner AS e FROM jd UNION ALL SELECT kind, loser FROM jd)),
    bs AS (SELECT * FROM oc UNION ALL SELECT kind, opponent, entity, 1 - score, weight FROM oc),
    ge AS (SELECT s.*, b.mu, o.mu AS omu, 1 / sqrt(1 + 3 * (o.phi / 173.7178) ** 2 / pi() ** 2) AS g FROM bs s JOIN bf b ON b.kind = s.kind AND b.entity = s.entity JOIN bf o ON o.kind = s.kind AND o.entity = s.opponent),
    gx AS (SELECT *, 1 / (1 + exp(-g * (mu - omu) / 173.7178)) AS e FROM ge)"""


def judged(spark, d) -> DataFrame:
    b = F.col("choice") == "b"
    won, lost = F.when(b, F.col("b")).otherwise(F.col("a")), F.when(b, F.col("a")).otherwise(F.col("b"))
    score = F.when(F.col("choice") == "neither", 0.5).otherwise(1.0)
    return log(spark, d).where("choice is not null").select("kind", F.col("judged_at").alias("at"), won.alias("winner"), lost.alias("loser"), score.alias("score"), (F.col("key") % 11 / 10).alias("agreement"))


def last_runs(spark) -> DataFrame:
    return spark.createDataFrame([("k0", SINCE), ("k1", datetime.datetime(2024, 1, 5))], "kind string, since timestamp")


def before(spark) -> DataFrame:
    e = F.col("entity")
    rows = spark.range(100).select(F.explode(F.array(*map(F.lit, ("k0", "k1", "k2")))).alias("kind"), F.col("id").alias("entity")).where("entity % 3 <> 0")
    return rows.select("kind", "entity", (1500.0 + e % 7 * 20).alias("mu"), (200.0 + e % 5 * 10).alias("phi"), F.lit(0.06).alias("sigma"), (e % 4).alias("games"), (e % 2).alias("wins"), F.lit(0).cast("long").alias("losses"), F.lit(0).cast("long").alias("draws"))


@query(JUDGED + " SELECT kind, entity, count(*) AS games, sum(score) AS points, round(sum(weight), 6) AS weight FROM oc GROUP BY 1, 2", "evt")
def rating_outcomes(spark, d):
    o = sm.outcomes(sm.since_last(judged(spark, d), last_runs(spark)))
    return o.groupBy("kind", "entity").agg(F.count("*").alias("games"), F.sum("score").alias("points"), F.round(F.sum("weight"), 6).alias("weight"))


@query(JUDGED + BEFORE + " SELECT kind, entity, round(sum(weight * g * g * e * (1 - e)), 6) AS v_inv, round(sum(weight * g * (score - e)), 6) AS gain, count(*) AS games FROM gx GROUP BY 1, 2", "evt")
def rating_evidence(spark, d):
    o = sm.both_sides(sm.outcomes(sm.since_last(judged(spark, d), last_runs(spark))), as_reference=True)
    x = ev.glicko_evidence(o, before(spark).select("kind", "entity", "mu", "phi", "sigma"), keys=("kind",))
    return six(x.where("games > 0").select("kind", "entity", "v_inv", "gain", "games"), "v_inv", "gain")


def batch(spark, d) -> DataFrame:
    return sm.rating_batch(judged(spark, d), before(spark), last_runs(spark), as_reference=True)


@query()
def rating_batch(spark, d):
    return batch(spark, d)


@query(
    JUDGED + """, mt AS (SELECT DISTINCT kind, e AS entity FROM (SELECT kind, winner AS e FROM nj UNION ALL SELECT kind, loser FROM nj)),
    wl AS (SELECT kind, entity, count(*) AS n, count(*) FILTER (score = 1) AS w, count(*) FILTER (score = 0) AS l, count(*) FILTER (score = 0.5) AS dr FROM oc GROUP BY 1, 2)
    SELECT kind, entity, CASE WHEN entity % 3 <> 0 THEN entity % 4 ELSE 0 END + coalesce(n, 0) AS games, CASE WHEN entity % 3 <> 0 THEN entity % 2 ELSE 0 END + coalesce(w, 0) AS wins, coalesce(l, 0) AS losses, coalesce(dr, 0) AS draws FROM mt LEFT JOIN wl USING (kind, entity)""",
    "evt",
)
def rating_batch_tally(spark, d):
    return batch(spark, d).select("kind", "entity", "games", "wins", "losses", "draws")


@query(
    JUDGED + """, wd AS (SELECT kind, winner, loser, score, agreement FROM jd WHERE agreement > 0), du AS (SELECT kind, winner, loser, agreement AS weight FROM wd WHERE score = 1 UNION ALL SELECT kind, winner, loser, agreement / 2 FROM wd WHERE score = 0.5 UNION ALL SELECT kind, loser, winner, agreement / 2 FROM wd WHERE score = 0.5)
    SELECT kind, winner, loser, round(sum(weight), 6) AS weight FROM du GROUP BY 1, 2, 3""",
    "evt",
)
def strength_duels(spark, d):
    return six(sm.duels(judged(spark, d).withColumnRenamed("agreement", "weight")).groupBy("kind", "winner", "loser").agg(F.sum("weight").alias("weight")), "weight")


# -- held-out checks ---------------------------------------------------------------------------------------------------

PREDICTED = """, rt AS (SELECT id AS work_id, id % 10 + 1 AS rating, 0.5 + (id % 4) / 4 AS conf, id * 7919 % 101 % 5 = 0 AS held, kudos FROM works),
    s AS (SELECT tag, sum((rating - 5.5) * conf) / (sum(conf) + 3) AS s FROM carried JOIN rt USING (work_id) WHERE NOT held GROUP BY 1), prof AS (SELECT tag, s / (SELECT max(abs(s)) FROM s) AS weight FROM s),
    sc AS (SELECT work_id, coalesce(sum(weight), 0) / sqrt(count(*)) AS score FROM carried LEFT JOIN prof USING (tag) GROUP BY 1), pr AS (SELECT work_id AS id, rating, kudos, round(coalesce(score, 0), 6) AS predicted FROM rt LEFT JOIN sc USING (work_id) WHERE held)"""


def predicted(spark, d) -> DataFrame:
    r = catalog(spark, d)
    rated = r.works.select("id", (F.col("id") % 10 + 1).alias("rating"), (0.5 + (F.col("id") % 4) / 4).alias("confidence"))
    return six(sm.predictions(rated, r.works, r.work_tags, F.col("id") * 7919 % 101 % 5 == 0), "predicted")


@query(PREDICTED + " SELECT id, rating, predicted, kudos FROM pr", "works carried")
def validation_predictions(spark, d):
    return predicted(spark, d)


@query(PREDICTED + " SELECT rating, count(*) AS n, round(avg(predicted), 6) AS predicted FROM pr GROUP BY 1", "works carried")
def validation_bands(spark, d):
    return six(sm.rating_bands(predicted(spark, d)), "predicted")


@query(
    PREDICTED + """, rk AS (SELECT rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2 AS p, rank() OVER (ORDER BY kudos) + (count(*) OVER (PARTITION BY kudos) - 1) / 2 AS k, rank() OVER (ORDER BY rating) + (count(*) OVER (PARTITION BY rating) - 1) / 2 AS r FROM pr),
    v AS (SELECT count(*) AS n, corr(p, r) AS profile, corr(k, r) AS baseline FROM rk)
    SELECT n, round(profile, 6) AS profile, round(baseline, 6) AS baseline, round(profile - baseline, 6) AS gain, CASE WHEN profile < 0 THEN 'negative' WHEN profile - baseline <= 0.02 THEN 'no better' WHEN profile < 0.2 THEN 'weak' WHEN profile < 0.35 THEN 'usable' ELSE 'strong' END AS verdict FROM v""",
    "works carried",
)
def validation(spark, d):
    return six(sm.validation(predicted(spark, d)), "profile", "baseline", "gain")


@query(
    HELD + """, pop AS (SELECT id AS work_id, row_number() OVER (ORDER BY kudos DESC, id) AS place FROM works QUALIFY place <= 50), pl AS (SELECT work_id, coalesce(place, 0) AS rank FROM held LEFT JOIN pop USING (work_id) WHERE held_out)
    SELECT tag_type AS axis, tag AS name, count(*) AS n, count(*) FILTER (rank > 0) AS hits, round(count(*) FILTER (rank > 0) / count(*), 6) AS rate FROM pl JOIN work_tags USING (work_id) WHERE tag_type IN ('brand', 'size') GROUP BY 1, 2 HAVING count(*) >= 5""",
    "works reads work_tags",
)
def slices_by_axis(spark, d):
    r = catalog(spark, d)
    place = F.row_number().over(W.orderBy(F.desc("kudos"), "id"))
    list_ = op.top_by(r.works, "kudos", 50).select(F.col("id").alias("work_id"), place.alias("place"))
    held = holdout(op.reads(r.interactions)).where("held_out")
    placed = held.join(F.broadcast(list_), "work_id", "left").select(F.col("work_id").alias("work"), F.coalesce("place", F.lit(0)).alias("rank"))
    axis = lambda a: sm.by_group(placed, r.work_tags.where(F.col("tag_type") == a).select(F.col("work_id").alias("work"), F.col("tag").alias("name")), a, 5)
    return six(axis("brand").union(axis("size")), "rate")


@query(
    RECS + """, p AS (SELECT user_id, count(*) FILTER (hit) AS hits, sum(CASE WHEN hit THEN 1 / log2(pos + 1) ELSE 0 END) AS dcg FROM hit WHERE pos <= 10 GROUP BY 1)
    SELECT user_id, need AS held_out, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / need, 6) AS recall, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(need, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM need LEFT JOIN p USING (user_id)""",
    "works reads",
)
def reader_results(spark, d):
    return six(sm.reader_results(*popularity_lists(catalog(spark, d)), 10), "recall", "ndcg")


@query()
def paired_comparison(spark, d):
    """The popularity list's first ten places against its next ten, reader by reader."""
    hit, need = popularity_lists(catalog(spark, d))
    later = hit.where("pos > 10").withColumn("pos", F.col("pos") - 10)
    return sm.paired(sm.reader_results(later, need, 10), sm.reader_results(hit, need, 10), "user_id", ["recall", "ndcg", "hits"])


# -- credit by seed, snapshots, queue ----------------------------------------------------------------------------------


@query(
    """, l AS (SELECT event_id AS key, user_id, k % 5 AS seed, ts, event_type = 'click' AS click FROM evt WHERE event_type IN ('view', 'click')),
    h AS (SELECT *, sum(CASE WHEN click THEN -1 ELSE 1 END) OVER (PARTITION BY user_id, seed ORDER BY ts, key) AS height FROM l), m AS (SELECT *, least(0, min(height) OVER (PARTITION BY user_id, seed ORDER BY ts, key)) AS low FROM h),
    v AS (SELECT *, coalesce(lag(low) OVER (PARTITION BY user_id, seed ORDER BY ts, key), 0) AS was FROM m), z AS (SELECT *, height - low + click::INT AS level FROM v WHERE NOT click OR low = was),
    c AS (SELECT key, click, lag(key) OVER (PARTITION BY user_id, seed, level ORDER BY ts, key) AS impression FROM z) SELECT key AS click, impression FROM c WHERE click""",
    "evt",
)
def seed_credit(spark, d):
    e = events(spark, d).where("event_type in ('view', 'click')")
    rows = e.select("user_id", (F.col("k") % 5).alias("seed"), "ts", F.col("event_id").alias("key"), (F.col("event_type") == "click").alias("click"))
    return sm.seed_credit(rows, ["user_id", "seed"], "ts", "key")


MANIFESTS = """m AS (SELECT p_partkey::BIGINT AS v, p_size % 3 <> 1 AS f, CASE WHEN p_size % 3 <> 1 THEN CASE WHEN p_size % 4 = 0 THEN p_partkey::BIGINT - 1 END ELSE CASE WHEN p_size % 7 <> 0 THEN p_partkey::BIGINT - p_size % 5 - 1 END END AS b FROM part)"""


def manifests(spark, d) -> DataFrame:
    v, s = F.col("p_partkey").cast("long"), F.col("p_size")
    base = F.when(s % 3 != 1, F.when(s % 4 == 0, v - 1)).otherwise(F.when(s % 7 != 0, v - s % 5 - 1))
    return table(spark, d, "part").select(v.alias("version"), (s % 3 != 1).alias("full"), base.cast("long").alias("base"))


@query(
    f"""WITH {MANIFESTS}, r AS (SELECT v, CASE WHEN (v + 1) % 20 = 0 THEN 'on the interval' WHEN f AND b IS NOT NULL THEN 'full with a base' WHEN NOT f AND b IS NULL THEN 'delta without a base' WHEN NOT f THEN 'no delta on a delta' ELSE 'delta' END AS reason FROM m)
    SELECT v + 1 AS version, reason <> 'delta' AS "full", CASE WHEN reason = 'delta' THEN v END AS base, reason FROM r"""
)
def snapshot_plan(spark, d):
    return sm.snapshot_plan(manifests(spark, d))


@query(f"WITH {MANIFESTS}, n AS (SELECT * FROM m ORDER BY v DESC LIMIT 3) SELECT v AS version FROM m WHERE v NOT IN (SELECT v FROM n) AND v NOT IN (SELECT b FROM n WHERE b IS NOT NULL)")
def prunable_snapshots(spark, d):
    return sm.prunable(manifests(spark, d))


@query(QUEUE + " SELECT url, state FROM qu ORDER BY taken_at DESC, url DESC LIMIT 20", "evt")
def recently_queued(spark, d):
    return sm.recent(queue(spark, d), "taken_at", 20).select("url", "state")


# -- pages made of known rows and read back ----------------------------------------------------------------------------


@query("SELECT p_partkey::BIGINT * 7 AS bookmark, p_partkey::BIGINT AS work, p_name || ' & ' || p_brand AS title, p_size || ' Mar 2024' AS shown, CASE WHEN p_size % 2 = 0 THEN p_size::BIGINT * 1000 END AS readers FROM part")
def bookmark_pages(spark, d):
    """A page of bookmarks per brand."""
    x = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    k, s = F.col("p_partkey"), F.col("p_size")
    status = F.when(s % 2 == 0, x('<p class="status" title="', F.format_number(s * 1000, 0), ' Bookmarks"></p>')).otherwise(F.lit(""))
    head = x('<li id="bookmark_', k * 7, '" class="bookmark blurb group work-', k, ' user-1"><a href="/works/', k, '">', F.col("p_name"), " &amp; ", F.col("p_brand"), "</a>")
    item = F.concat(head, status, x('<p class="datetime">', s, " Mar 2024</p></li>"))
    pages = table(spark, d, "part").groupBy("p_brand", (k % 64).alias("page")).agg(F.concat_ws("\n", F.collect_list(item)).alias("html"))
    return pages.select(F.explode(ht.bookmarks(F.concat(F.lit("<ol>"), F.col("html"), F.lit("</ol>")))).alias("b")).select("b.*")


@query("SELECT p_name || '''s ' || p_brand AS name, p_name || '''s + 100% ' || p_brand AS path, p_size::BIGINT * 1000 AS works FROM part")
def universe_pages(spark, d):
    """A page of the catalogue per brand."""
    x = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    n, b = F.col("p_name"), F.col("p_brand")
    path = x(F.replace(n, F.lit(" "), F.lit("%20")), "&#39;s%20+%20100%25%20", F.replace(b, F.lit(" "), F.lit("%20")))
    item = x('<li><a class="tag" href="/tags/', path, '/works">', n, "&#39;s ", b, "</a>\n (", F.format_number(F.col("p_size") * 1000, 0), ")</li>")
    pages = table(spark, d, "part").groupBy("p_brand", (F.col("p_partkey") % 64).alias("page")).agg(F.concat_ws("\n", F.collect_list(item)).alias("html"))
    return pages.select(F.explode(ht.universe_links(F.col("html"))).alias("u")).select("u.*")


@query(
    """WITH t AS (SELECT p_partkey::BIGINT AS book, p_size % 12 AS s, p_size, p_name, p_brand FROM part)
    SELECT book, CASE WHEN s <= 10 THEN s ELSE 0 END::BIGINT AS rating, s <= 10 AS rated, p_name || CASE WHEN p_size % 7 = 0 THEN '(2)' ELSE '' END AS title, p_brand || CASE WHEN p_size % 5 = 0 THEN '-jr' ELSE '' END AS author,
    CASE WHEN p_size % 7 = 0 THEN p_name || ' (2)' ELSE '' END AS alt_title, CASE WHEN p_size % 5 = 0 THEN p_brand || ' -jr' ELSE '' END AS alt_author FROM t"""
)
def rated_lists(spark, d):
    """Lists of 64 readers as a book manager prints them."""
    s = F.col("p_size") % 12
    line = F.concat(F.rpad(F.col("p_partkey").cast("string"), 12, " "), F.rpad(F.when(s <= 10, s.cast("string")).otherwise("None"), 6, " "), F.rpad("p_name", 70, " "), F.lit("  "), "p_brand")
    more = F.concat(F.when(F.col("p_size") % 7 == 0, "\n                  (2)").otherwise(""), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("\n"), F.rpad(F.lit(""), 90, " "), F.lit("-jr"))).otherwise(""))
    text = F.concat(F.lit("a list\nid          *rating title      authors\n"), F.concat_ws("\n", F.collect_list(F.concat(line, more))))
    return paste.rated_lists(table(spark, d, "part").groupBy((F.col("p_partkey") % 64).alias("paste")).agg(text.alias("text"))).drop("paste")

"""Queries over the event log: visits, impressions, credit, stances, queues, ratings and experiments, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators import assess as sm
from quillspark.operators import corpus as op
from quillspark.operators import events as ev
from quillspark.plans.corpus import events
from quillspark.plans.ranking import RATED, ratings
from quillspark.plans.registry import query
from quillspark.sources.tables import catalog

GAP = 480  # minutes: the test log is sparse

# impressions: views; clicks: click events; a pair of arms per entity
SHOWN = ", shown AS (SELECT event_id AS key, user_id AS owner, k % 10 AS item, ts, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS arm, 'x' || (k % 3) AS arm_a, 'y' || (k % 2) AS arm_b FROM evt WHERE event_type = 'view')"
CLICKS = ", clicks AS (SELECT event_id AS key, user_id AS owner, k % 10 AS item, ts FROM evt WHERE event_type = 'click')"
CREDIT = """, credit AS (SELECT click, impression FROM (SELECT c.key AS click, s.key AS impression, row_number() OVER (PARTITION BY c.key ORDER BY s.ts DESC, s.key DESC) AS rn FROM clicks c JOIN shown s USING (owner, item)
    WHERE (s.ts < c.ts OR (s.ts = c.ts)) AND epoch_us(c.ts) - epoch_us(s.ts) <= 72 * 3600000000) WHERE rn = 1)"""


def shown(spark, d) -> DataFrame:
    e = events(spark, d).where("event_type = 'view'")
    arm = F.when(F.col("event_id") % 2 == 0, "a").otherwise("b")
    return e.select(F.col("event_id").alias("key"), F.col("user_id").alias("owner"), (F.col("k") % 10).alias("item"), "ts", arm.alias("arm"), F.concat(F.lit("x"), (F.col("k") % 3).cast("string")).alias("arm_a"), F.concat(F.lit("y"), (F.col("k") % 2).cast("string")).alias("arm_b"))


def clicks(spark, d) -> DataFrame:
    return events(spark, d).where("event_type = 'click'").select(F.col("event_id").alias("key"), F.col("user_id").alias("owner"), (F.col("k") % 10).alias("item"), "ts")


VISITS = f""", g AS (SELECT user_id, ts, event_id, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= {GAP}::BIGINT * 60000000)::INT, 1) AS fresh FROM evt),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS visit FROM g),
    v AS (SELECT user_id, visit::BIGINT AS visit, min(ts) AS started, max(ts) AS last, count(*) AS events FROM n GROUP BY 1, 2)"""


@query(VISITS + " SELECT user_id, visit, epoch_us(started) AS started, epoch_us(last) AS last, events FROM v", "evt")
def visits(spark, d):
    v = ev.visits(events(spark, d), "user_id", "ts", "event_id", GAP)
    return v.select("user_id", "visit", F.unix_micros("started").alias("started"), F.unix_micros("last").alias("last"), "events")


@query(VISITS + " SELECT user_id, epoch_us(arg_max(p, visit)) AS previous_at, epoch_us(arg_max(started, visit)) AS current_at, max(visit) AS visits FROM (SELECT *, coalesce(lag(last) OVER (PARTITION BY user_id ORDER BY visit), TIMESTAMP '1970-01-01') AS p FROM v) GROUP BY 1", "evt")
def visit_cursor(spark, d):
    c = ev.visit_cursor(ev.visits(events(spark, d), "user_id", "ts", "event_id", GAP), "user_id")
    return c.select("user_id", F.coalesce(F.unix_micros("previous_at"), F.lit(0)).alias("previous_at"), F.unix_micros("current_at").alias("current_at"), "visits")


@query(
    SHOWN
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY owner, item ORDER BY ts, key) AS rn FROM shown), h AS (SELECT owner, item, list(epoch_us(ts) ORDER BY rn) AS t, list(key ORDER BY rn) AS ks FROM o GROUP BY 1, 2),
    f AS (SELECT owner, item, list_reduce(list_prepend([ks[1], t[1]], list_transform(range(2, len(t) + 1), lambda i: [ks[i], t[i]])), lambda a, x: CASE WHEN x[2] - a[len(a)] >= 24 * 3600000000 THEN list_concat(a, x) ELSE a END) AS kept FROM h)
    SELECT owner, item, unnest(list_transform(range(1, len(kept) // 2 + 1), lambda i: kept[2 * i - 1])) AS key FROM f""",
    "evt",
)
def impression_dedupe(spark, d):
    return ev.impressions_deduped(shown(spark, d), "owner", "item", "ts", "key", 24)


@query(SHOWN + CLICKS + CREDIT + " SELECT click, impression FROM credit", "evt")
def last_touch_credit(spark, d):
    return ev.last_touch(clicks(spark, d), shown(spark, d), "owner", "item", "ts", "key", 72)


@query(
    SHOWN + CLICKS
    + """, lists AS (SELECT key AS list_id, owner, ts, unnest([item, (item + 1) % 10, (item + 2) % 10]) AS item FROM shown)
    SELECT click, list_id AS impression FROM (SELECT c.key AS click, l.list_id, row_number() OVER (PARTITION BY c.key ORDER BY l.ts DESC, l.list_id DESC) AS rn FROM clicks c JOIN lists l USING (owner, item) WHERE l.ts <= c.ts) WHERE rn = 1""",
    "evt",
)
def list_credit(spark, d):
    lists = shown(spark, d).select(F.col("key").alias("list_id"), "owner", "ts", F.array("item", (F.col("item") + 1) % 10, (F.col("item") + 2) % 10).alias("items"))
    return ev.list_credit(clicks(spark, d).withColumnRenamed("key", "click_id"), lists, "owner", "item", "ts")


@query(
    SHOWN + CLICKS + CREDIT + """, bought AS (SELECT DISTINCT user_id AS owner, k % 10 AS item FROM evt WHERE event_type = 'purchase')
    SELECT owner, item, count(*) AS times, string_agg(DISTINCT arm, ',' ORDER BY arm) AS arms FROM shown s WHERE key NOT IN (SELECT impression FROM credit) AND NOT EXISTS (SELECT 1 FROM bought b WHERE b.owner = s.owner AND b.item = s.item) GROUP BY 1, 2 HAVING count(*) >= 2""",
    "evt",
)
def skipped_works(spark, d):
    s = shown(spark, d)
    credited = ev.last_touch(clicks(spark, d), s, "owner", "item", "ts", "key", 72).select(F.col("impression").alias("key")).distinct()
    bought = events(spark, d).where("event_type = 'purchase'").select(F.col("user_id").alias("owner"), (F.col("k") % 10).alias("item"))
    return ev.skipped(s, credited, bought, "owner", "item", 2)


@query(
    """, cur AS (SELECT user_id AS owner, min(ts) AS since FROM evt WHERE event_type = 'signup' GROUP BY 1), items AS (SELECT k AS item, max(ts) AS ts FROM evt GROUP BY 1), seen AS (SELECT DISTINCT user_id AS owner, k AS item FROM evt)
    SELECT owner, item FROM cur JOIN items ON ts > since WHERE (owner, item) NOT IN (SELECT (owner, item) FROM seen)""",
    "evt",
)
def new_since(spark, d):
    e = events(spark, d)
    cursor = e.where("event_type = 'signup'").groupBy(F.col("user_id").alias("owner")).agg(F.min("ts").alias("since"))
    items = e.groupBy(F.col("k").alias("item")).agg(F.max("ts").alias("ts"))
    return ev.new_since(items, cursor, e.select(F.col("user_id").alias("owner"), F.col("k").alias("item")), "owner", "item", "ts")


@query("SELECT user_id, k % 10 AS tag, round(avg(value), 6) AS weight, count(*) AS n FROM evt GROUP BY 1, 2", "evt")
def running_tag_weight(spark, d):
    e = events(spark, d).withColumn("tag", F.col("k") % 10)
    return ev.running_mean(e, ["user_id", "tag"], "value").withColumn("weight", F.round("weight", 6))


STANCE = "CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END"


@query(f", s AS (SELECT event_id, user_id, k % 5 AS item, ts, {STANCE} AS stance FROM evt WHERE event_type IN ('purchase', 'error')) SELECT event_id, stance, coalesce(lag(stance) OVER w, 0) AS was, stance - coalesce(lag(stance) OVER w, 0) AS delta FROM s WINDOW w AS (PARTITION BY user_id, item ORDER BY ts, event_id)", "evt")
def stance_reversal(spark, d):
    e = events(spark, d).where(F.col("event_type").isin("purchase", "error")).select("event_id", "user_id", (F.col("k") % 5).alias("item"), "ts", F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("stance"))
    return ev.stance_changes(e, "user_id", "item", "ts", "event_id", "stance").select("event_id", "stance", "was", "delta")


@query("SELECT event_type AS source, count(*) AS jobs, count(*) FILTER (NOT (value > 60) AND NOT (k % 7 >= 5)) AS pending, count(*) FILTER (value > 60) AS done, count(*) FILTER (NOT (value > 60) AND k % 7 >= 5) AS parked FROM evt GROUP BY 1", "evt")
def queue_status(spark, d):
    jobs = events(spark, d).select(F.col("event_type").alias("source"), (F.col("k") % 7).alias("attempts"), F.when(F.col("value") > 60, F.col("ts")).alias("done_at"))
    return ev.queue_status(jobs)


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM evt) WHERE rn = 1", "evt")
def latest_choice(spark, d):
    return ev.latest_per_key(events(spark, d), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


# -- comparisons -------------------------------------------------------------------------------------------------------

GAMES = ", games AS (SELECT event_id AS key, user_id % 10 AS owner, k % 40 AS a, (k * 7 + 3) % 40 AS b, CASE WHEN event_id % 5 = 0 THEN 'draw' WHEN value > 50 THEN 'a' ELSE 'b' END AS winner FROM evt WHERE k % 40 <> (k * 7 + 3) % 40)"


def games(spark, d) -> DataFrame:
    e = events(spark, d)
    w = F.when(F.col("event_id") % 5 == 0, "draw").when(F.col("value") > 50, "a").otherwise("b")
    g = e.select(F.col("event_id").alias("key"), (F.col("user_id") % 10).alias("owner"), (F.col("k") % 40).alias("a"), ((F.col("k") * 7 + 3) % 40).alias("b"), w.alias("winner"))
    return g.where("a <> b")


SIDES = ", sd AS (SELECT a AS entity, b AS opponent, CASE winner WHEN 'draw' THEN 0.5 WHEN 'a' THEN 1.0 ELSE 0.0 END AS score FROM games UNION ALL SELECT b, a, CASE winner WHEN 'draw' THEN 0.5 WHEN 'a' THEN 0.0 ELSE 1.0 END FROM games)"


@query(GAMES + SIDES + " SELECT entity, count(*) FILTER (score = 1) AS wins, count(*) FILTER (score = 0) AS losses, count(*) FILTER (score = 0.5) AS draws FROM sd GROUP BY 1", "evt")
def rating_tally(spark, d):
    return ev.tally(ev.sides(games(spark, d)))


@query(GAMES + SIDES + " SELECT entity, count(*) FILTER (score = 1) AS wins, count(*) FILTER (score = 0) AS losses, count(*) FILTER (score = 0.5 AND entity < opponent) AS draws FROM sd GROUP BY 1", "evt")
def rating_tally_literal(spark, d):
    return ev.tally(ev.sides(games(spark, d), as_reference=True))


@query()
def glicko_period(spark, d):
    none = spark.createDataFrame([], "entity long, mu double, phi double, sigma double")
    return ev.glicko_period(ev.sides(games(spark, d)), none)


@query()
def bradley_terry(spark, d):
    g = games(spark, d)
    duel = lambda w, l, weight, cond: g.where(cond).select(F.col(w).alias("winner"), F.col(l).alias("loser"), F.lit(weight).alias("weight"))  # noqa: E731, E741
    duels = duel("a", "b", 1.0, "winner = 'a'").union(duel("b", "a", 1.0, "winner = 'b'")).union(duel("a", "b", 0.5, "winner = 'draw'")).union(duel("b", "a", 0.5, "winner = 'draw'"))
    return ev.bradley_terry(duels)


@query(RATED + " SELECT id, mu, phi, round(m + (mu - m) * greatest(0.0, least(1.0, 1 - phi / 350)), 6) AS effective, row_number() OVER (ORDER BY mu DESC, phi, id) AS place FROM rated, med", "works")
def leaderboard(spark, d):
    return ev.leaderboard(ratings(catalog(spark, d).works)).withColumn("effective", F.round("effective", 6))


@query(
    GAMES + """, g AS (SELECT 'algo' || a % 5 AS a, 'algo' || b % 5 AS b, winner FROM games WHERE a % 5 <> b % 5), u AS (SELECT a AS algo, 'a' AS side, winner FROM g UNION ALL SELECT b, 'b', winner FROM g),
    s AS (SELECT algo, count(*) FILTER (winner = side) AS wins, count(*) FILTER (winner <> side AND winner <> 'draw') AS losses, count(*) FILTER (winner = 'draw') AS ties, count(*) AS judged FROM u GROUP BY 1)
    SELECT *, (SELECT round(CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2)))) END, 6) FROM (SELECT unnest(range(0, least(wins, losses) + 1)) AS i)) AS p FROM s""",
    "evt",
)
def algo_standings(spark, d):
    g = games(spark, d).select(F.concat(F.lit("algo"), (F.col("a") % 5).cast("string")).alias("a"), F.concat(F.lit("algo"), (F.col("b") % 5).cast("string")).alias("b"), "winner").where("a <> b")
    return ev.algorithm_standings(g).withColumn("p", F.round("p", 6))


def credited(spark, d) -> DataFrame:
    s = shown(spark, d)
    hit = ev.last_touch(clicks(spark, d), s, "owner", "item", "ts", "key", 72).select(F.col("impression").alias("key")).distinct()
    return s.join(hit.withColumn("credited", F.lit(1)), "key", "left").na.fill({"credited": 0})


@query(
    SHOWN + CLICKS + CREDIT + """, c AS (SELECT s.*, (key IN (SELECT impression FROM credit))::INT AS credited FROM shown s)
    SELECT arm_a, arm_b, count(*) FILTER (arm = 'a') AS slots_a, coalesce(sum(credited) FILTER (arm = 'a'), 0)::BIGINT AS credits_a, count(*) FILTER (arm = 'b') AS slots_b, coalesce(sum(credited) FILTER (arm = 'b'), 0)::BIGINT AS credits_b FROM c GROUP BY 1, 2""",
    "evt",
)
def interleave_standings(spark, d):
    return ev.interleave_standings(credited(spark, d)).select("arm_a", "arm_b", "slots_a", "credits_a", "slots_b", "credits_b")


@query()
def interleave_fisher(spark, d):
    return ev.interleave_standings(credited(spark, d)).select("arm_a", "arm_b", "p")


@query(SHOWN + CLICKS + CREDIT + " SELECT arm_a AS algo, arm, count(*) AS impressions, sum((key IN (SELECT impression FROM credit))::INT)::BIGINT AS credits, round(avg((key IN (SELECT impression FROM credit))::INT), 6) AS rate FROM shown GROUP BY 1, 2", "evt")
def impression_rates(spark, d):
    return credited(spark, d).groupBy(F.col("arm_a").alias("algo"), "arm").agg(F.count("*").alias("impressions"), F.sum("credited").cast("long").alias("credits"), F.round(F.avg("credited"), 6).alias("rate"))


DECIDED = GAMES + ", dec AS (SELECT key, owner, CASE winner WHEN 'a' THEN a ELSE b END AS winner, CASE winner WHEN 'a' THEN b ELSE a END AS loser FROM games WHERE winner <> 'draw')"


@query(
    DECIDED + """, d5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner, loser ORDER BY key) AS rn FROM dec) WHERE rn <= 5),
    x AS (SELECT owner, key, tag, 1 AS w FROM d5 JOIN carried ON work_id = winner UNION ALL SELECT owner, key, tag, -1 FROM d5 JOIN carried ON work_id = loser),
    y AS (SELECT owner, key, tag, sum(w) AS w FROM x GROUP BY 1, 2, 3 HAVING count(*) = 1) SELECT owner, tag, round(avg(w), 6) AS weight, count(*) AS n FROM y GROUP BY 1, 2""",
    "evt carried",
)
def tag_learning(spark, d):
    g = games(spark, d).where("winner <> 'draw'")
    dec = g.select("key", "owner", F.when(F.col("winner") == "a", F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(F.col("winner") == "a", F.col("b")).otherwise(F.col("a")).alias("loser"))
    return ev.tag_learning(dec, catalog(spark, d).work_tags).withColumn("weight", F.round("weight", 6))


@query()
def team_draft(spark, d):
    w = catalog(spark, d).works.withColumn("request", F.col("id") % 8)
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("k"), "id"))), lambda s: s["id"])
    lists = w.groupBy("request").agg(order("kudos").alias("a"), order("hits").alias("b"))
    return ev.team_drafts(lists.select("request", F.slice("a", 1, 30).alias("a"), F.slice("b", 1, 30).alias("b")), 20)


# -- evaluation --------------------------------------------------------------------------------------------------------

HELD = ", ranked AS (SELECT user_id, work_id, row_number() OVER (PARTITION BY user_id ORDER BY (work_id * 48271 + user_id * 11) % 2147483647, work_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM reads), held AS (SELECT user_id, work_id, rn <= floor(0.2 * n + 0.5) AS held_out FROM ranked WHERE n >= 5)"


def holdout(reads: DataFrame, share: float = 0.2, least: int = 5) -> DataFrame:
    """(user_id, work_id, held_out): a hash-drawn share of each reader's works, readers of `least` works or more only."""
    w = W.partitionBy("user_id").orderBy((F.col("work_id") * 48271 + F.col("user_id") * 11) % 2147483647, "work_id")
    n = F.count("*").over(W.partitionBy("user_id"))
    return reads.withColumn("rn", F.row_number().over(w)).withColumn("n", n).where(F.col("n") >= least).select("user_id", "work_id", (F.col("rn") <= F.floor(share * F.col("n") + 0.5)).alias("held_out"))


@query(HELD + " SELECT user_id, work_id, held_out FROM held", "reads")
def holdout_split(spark, d):
    return holdout(op.reads(catalog(spark, d).interactions))


RECS = HELD + """, recs AS (SELECT user_id, work_id, row_number() OVER (PARTITION BY user_id ORDER BY kudos DESC, work_id) AS pos FROM (SELECT DISTINCT user_id FROM held) u, (SELECT id AS work_id, kudos FROM works) w WHERE (user_id, work_id) NOT IN (SELECT (user_id, work_id) FROM held WHERE NOT held_out)),
    top AS (SELECT * FROM recs WHERE pos <= 50), hit AS (SELECT t.user_id, t.pos, h.work_id IS NOT NULL AS hit FROM top t LEFT JOIN held h ON h.user_id = t.user_id AND h.work_id = t.work_id AND h.held_out),
    need AS (SELECT user_id, count(*) AS need FROM held WHERE held_out GROUP BY 1)"""


def popularity_lists(r, k: int = 50) -> tuple[DataFrame, DataFrame]:
    """(user_id, pos, hit) of the k most popular works that each reader isn't known to have read, and (user_id, need)."""
    held = holdout(op.reads(r.interactions))
    place = op.places(r.works.select(F.col("id").alias("work_id"), "kudos"), "kudos", "work_id")
    known = held.where("not held_out").join(place, "work_id")
    before = F.col("place") - F.row_number().over(W.partitionBy("user_id").orderBy("place"))  # works not known that stand above a known one
    inside = known.withColumn("before", before).where(F.col("before") < k).select("user_id", "place")
    readers = held.select("user_id").distinct().join(inside.groupBy("user_id").agg(F.count("*").alias("more")), "user_id", "left")
    readers = readers.select("user_id", (F.coalesce("more", F.lit(0)) + k).alias("depth"))
    mine = readers.select("user_id", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("place")).join(inside, ["user_id", "place"], "left_anti").join(place.select("work_id", "place"), "place")
    top = mine.withColumn("pos", F.row_number().over(W.partitionBy("user_id").orderBy("place")))
    hit = top.join(held.where("held_out").select("user_id", "work_id", F.lit(True).alias("hit")), ["user_id", "work_id"], "left").select("user_id", "pos", F.coalesce("hit", F.lit(False)).alias("hit"))
    return hit, held.where("held_out").groupBy("user_id").agg(F.count("*").alias("need"))


def recall_ndcg_of(hit: DataFrame, need: DataFrame, k: int) -> DataFrame:
    per = hit.where(F.col("pos") <= k).groupBy("user_id").agg(F.count_if("hit").alias("hits"), F.sum(F.when(F.col("hit"), 1 / F.log2(F.col("pos") + 1)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("need"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    per = need.join(per, "user_id", "left").select("user_id", (F.coalesce("hits", F.lit(0)) / F.col("need")).alias("recall"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"), (F.coalesce("hits", F.lit(0)) > 0).cast("double").alias("any"))
    return per.agg(F.count("*").alias("readers"), F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"), F.avg("any").alias("coverage"))


@query(
    RECS + """, p AS (SELECT user_id, count(*) FILTER (hit) AS hits, sum(CASE WHEN hit THEN 1 / log2(pos + 1) ELSE 0 END) AS dcg FROM hit WHERE pos <= 10 GROUP BY 1),
    q AS (SELECT coalesce(hits, 0) / need AS r, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(need, 10) + 1), lambda i: 1 / log2(i + 1))) AS g, (coalesce(hits, 0) > 0)::INT AS c FROM need LEFT JOIN p USING (user_id))
    SELECT count(*) AS readers, round(avg(r), 6) AS recall, round(avg(g), 6) AS ndcg, round(avg(c), 6) AS coverage FROM q""",
    "works reads",
)
def recall_ndcg(spark, d):
    out = recall_ndcg_of(*popularity_lists(catalog(spark, d)), 10)
    return out.select("readers", *(F.round(c, 6).alias(c) for c in ("recall", "ndcg", "coverage")))


@query(RECS + " SELECT CASE WHEN pos <= 3 THEN '1-3' WHEN pos <= 7 THEN '4-7' ELSE '8-50' END AS band, count(*) AS observed, count(*) FILTER (hit) AS hits, round(avg(hit::INT), 6) AS rate FROM hit GROUP BY 1", "works reads")
def calibration_bands(spark, d):
    hit, _ = popularity_lists(catalog(spark, d))
    band = F.when(F.col("pos") <= 3, "1-3").when(F.col("pos") <= 7, "4-7").otherwise("8-50")
    return hit.groupBy(band.alias("band")).agg(F.count("*").alias("observed"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("rate"))


@query(HELD + " SELECT tag AS name, count(*) AS n, count(*) FILTER (held_out) AS hits FROM held JOIN carried USING (work_id) GROUP BY 1 HAVING count(*) >= 50", "reads carried")
def slices(spark, d):
    r = catalog(spark, d)
    return holdout(op.reads(r.interactions)).join(op.carried(r.work_tags), "work_id").groupBy(F.col("tag").alias("name")).agg(F.count("*").alias("n"), F.count_if("held_out").alias("hits")).where("n >= 50")


@query(
    """, l AS (SELECT id, id % 20 AS lst FROM works), t AS (SELECT work_id AS id, list(tag) AS tags FROM carried GROUP BY 1),
    p AS (SELECT a.lst, len(list_intersect(x.tags, y.tags)) / len(list_distinct(list_concat(x.tags, y.tags))) AS jac FROM l a JOIN l b ON a.lst = b.lst AND a.id < b.id JOIN t x ON x.id = a.id JOIN t y ON y.id = b.id)
    SELECT lst, round(avg(jac), 6) AS mean_jaccard, count(*) AS pairs FROM p GROUP BY 1""",
    "works carried",
)
def intra_list_diversity(spark, d):
    return list_diversity(spark, d, "true")


def list_diversity(spark, d, which: str) -> DataFrame:
    r = catalog(spark, d)
    from quillspark.operators.assess import list_diversity as list_diversity_of
    from quillspark.operators.ranking import tag_sets

    t = op.apart(r.works.where(which).select("id", (F.col("id") % 20).alias("lst"))).join(op.apart(tag_sets(r.work_tags).withColumnRenamed("work_id", "id")), "id")
    return list_diversity_of(t).withColumn("mean_jaccard", F.round("mean_jaccard", 6))


@query()
def bootstrap_ci(spark, d):
    """Seeded paired bootstrap of each reader's hits in the first ten against the second ten places."""
    hit, _ = popularity_lists(catalog(spark, d))
    ten = lambda which: hit.where("pos <= 20").groupBy("user_id").agg(F.count_if(F.col("hit") & which).alias("hits"))
    out = sm.paired(ten(F.col("pos") > 10), ten(F.col("pos") <= 10), "user_id", ["hits"])
    return out.select(F.col("diff").alias("mean"), "low", "high", F.when(F.col("verdict") == "NO VERDICT", "NO VERDICT").otherwise("DIFFERENT").alias("verdict"))

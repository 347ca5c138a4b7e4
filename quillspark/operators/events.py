"""Event-log operators in batch form: visits, impressions, attribution, running weights, stances, queues; and experiments."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillspark.functions import stats

# -- event logs --------------------------------------------------------------------------------------------------------


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6


def visits(log: DataFrame, owner: str, at: str, key: str, gap_minutes: float) -> DataFrame:
    """(owner, visit, started, last, events): a pause of the gap or longer begins a new visit."""
    w = W.partitionBy(owner).orderBy(at, key)
    pause = F.unix_micros(at) - F.lag(F.unix_micros(at)).over(w)
    fresh = F.coalesce((pause >= int(gap_minutes * 60e6)).cast("int"), F.lit(1))
    numbered = log.withColumn("fresh", fresh).withColumn("visit", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(owner, "visit").agg(F.min(at).alias("started"), F.max(at).alias("last"), F.count("*").alias("events"))


def visit_cursor(v: DataFrame, owner: str) -> DataFrame:
    """Per owner: start of the current visit, end of the one before, number of visits."""
    w = W.partitionBy(owner).orderBy("visit")
    return v.withColumn("previous", F.lag("last").over(w)).groupBy(owner).agg(F.max_by("previous", "visit").alias("previous_at"), F.max_by("started", "visit").alias("current_at"), F.max("last").alias("last_at"), F.max("visit").alias("visits"))


def impressions_deduped(shown: DataFrame, owner: str, item: str, at: str, key: str, hours: float) -> DataFrame:
    """Impressions of an item to an owner that come `hours` or more after the last one kept.

    Kept ones chain: each is measured against the last kept, not the last shown; the owner's item history is folded in order.
    """
    order = F.array_sort(F.collect_list(F.struct(F.unix_micros(at).alias("t"), F.col(key).alias("key"))))
    span = int(hours * 3600e6)
    kept = F.aggregate(
        "h",
        F.array().cast("array<struct<t:bigint,key:bigint>>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x["t"] - F.try_element_at(acc, F.lit(-1))["t"] >= span), F.concat(acc, F.array(x))).otherwise(acc),
    )
    return shown.groupBy(owner, item).agg(order.alias("h")).select(owner, item, F.explode(kept).alias("k")).select(owner, item, F.col("k.key").alias(key))


def last_touch(clicks: DataFrame, shown: DataFrame, owner: str, item: str, at: str, key: str, within_hours: float) -> DataFrame:
    """(click, impression): each click credits the latest impression of its item to its owner within the window before it.

    One union and one window per (owner, item): a running last impression instead of a range join.
    """
    both = clicks.select(owner, item, at, key, F.lit(1).alias("is_click")).union(shown.select(owner, item, at, key, F.lit(0)))
    w = W.partitionBy(owner, item).orderBy(at, "is_click", key).rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("is_click") == 0, F.struct(F.col(key).alias("k"), F.unix_micros(at).alias("t"))), ignorenulls=True).over(w)
    hit = both.withColumn("last", last).where("is_click = 1").where(F.unix_micros(at) - F.col("last.t") <= int(within_hours * 3600e6))
    return hit.select(F.col(key).alias("click"), F.col("last.k").alias("impression"))


def list_credit(clicks: DataFrame, lists: DataFrame, owner: str, item: str, at: str) -> DataFrame:
    """Clicks credit the latest earlier list of their owner that shows the item. lists: (list_id, owner, at, items)."""
    shown = lists.select("list_id", owner, at, F.explode("items").alias(item)).withColumnRenamed("list_id", "key")
    return last_touch(clicks.withColumnRenamed("click_id", "key"), shown, owner, item, at, "key", 24 * 365)


def skipped(shown: DataFrame, credited: DataFrame, seen: DataFrame, owner: str, item: str, least: int) -> DataFrame:
    """Items shown `least` times or more to an owner without credit, and never read; with the arms that showed them."""
    open_ = shown.join(credited.select("key"), "key", "left_anti")
    out = open_.groupBy(owner, item).agg(F.count("*").alias("times"), F.array_join(F.array_sort(F.collect_set("arm")), ",").alias("arms")).where(F.col("times") >= least)
    return out.join(seen.select(owner, item).distinct(), [owner, item], "left_anti")


def new_since(items: DataFrame, cursor: DataFrame, seen: DataFrame, owner: str, item: str, at: str) -> DataFrame:
    """Items that appeared after an owner's last visit and that the owner hasn't seen. cursor: (owner, since)."""
    met = items.select(item, at).join(F.broadcast(cursor)).where(F.col(at) > F.col("since")).select(owner, item)
    return met.join(seen.select(owner, item).distinct(), [owner, item], "left_anti")


def running_mean(log: DataFrame, keys: list[str], value: str) -> DataFrame:
    return log.groupBy(*keys).agg(F.avg(value).alias("weight"), F.count("*").alias("n"))


def stance_changes(log: DataFrame, owner: str, item: str, at: str, key: str, stance: str) -> DataFrame:
    """Applied change of weight per stance event: the new stance less the one before; repeats change nothing."""
    w = W.partitionBy(owner, item).orderBy(at, key)
    return log.withColumn("was", F.coalesce(F.lag(stance).over(w), F.lit(0))).withColumn("delta", F.col(stance) - F.col("was"))


def queue_status(jobs: DataFrame, attempts: int = 5) -> DataFrame:
    """Pending, done and parked jobs per source."""
    done, parked = F.col("done_at").isNotNull(), (F.col("attempts") >= attempts) & F.col("done_at").isNull()
    return jobs.groupBy("source").agg(F.count("*").alias("jobs"), F.count_if(~done & ~parked).alias("pending"), F.count_if(done).alias("done"), F.count_if(parked).alias("parked"))


def latest_per_key(log: DataFrame, keys: list[str], at: str, key: str) -> DataFrame:
    """Last write wins."""
    return log.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(at), F.desc(key)))).where("rn = 1").drop("rn")


# -- comparisons, ratings and experiments ------------------------------------------------------------------------------


def sides(comparisons: DataFrame, as_reference: bool = False) -> DataFrame:
    """(entity, opponent, score) from comparisons (a, b, winner a|b|draw): each game once per side.

    as_reference: a draw enters its lower side only, as the original tallies it (in its rating periods decided games count twice: assess.both_sides).
    """
    score = F.when(F.col("winner") == "draw", 0.5).when(F.col("winner") == "a", 1.0).otherwise(0.0)
    one = comparisons.select(F.col("a").alias("entity"), F.col("b").alias("opponent"), score.alias("score"))
    two = comparisons.select(F.col("b").alias("entity"), F.col("a").alias("opponent"), (1 - score).alias("score"))
    if not as_reference:
        return one.union(two)
    return one.union(two).where("score <> 0.5 or entity < opponent")


def tally(side: DataFrame) -> DataFrame:
    return side.groupBy("entity").agg(F.count_if(F.col("score") == 1).alias("wins"), F.count_if(F.col("score") == 0).alias("losses"), F.count_if(F.col("score") == 0.5).alias("draws"))


def glicko_evidence(side: DataFrame, ratings: DataFrame, default=(1500.0, 350.0, 0.06), keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, entity, mu, phi, sigma, v_inv, gain, games): ratings before the period and the two sums over its games they move by.

    side: (*keys, entity, opponent, score) and a weight where games don't count in full; sums pre-aggregate, however many games one plays.
    """
    k = list(keys)
    base = [F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in zip(("mu", "phi", "sigma"), default)]
    met = side.select(*k, "entity", "opponent", "score", (F.col("weight") if "weight" in side.columns else F.lit(1.0)).alias("weight"))
    known = met.select(*k, "entity").union(met.select(*k, F.col("opponent").alias("entity"))).union(ratings.select(*k, "entity")).distinct().join(ratings, [*k, "entity"], "left").select(*k, "entity", *base)
    scaled = lambda c: (F.col(c) - stats.START) / stats.SCALE
    q = F.col("ophi") / stats.SCALE
    g = 1 / F.sqrt(1 + 3 * q * q / math.pi**2)
    e = 1 / (1 + F.exp(-F.col("g") * (scaled("mu") - scaled("omu"))))
    rows = met.join(known.select(*k, F.col("entity").alias("opponent"), F.col("mu").alias("omu"), F.col("phi").alias("ophi")), [*k, "opponent"]).join(known.select(*k, "entity", "mu"), [*k, "entity"])
    rows = rows.withColumn("g", g).withColumn("e", e)
    per = rows.groupBy(*k, "entity").agg(F.sum(F.expr("weight * g * g * e * (1 - e)")).alias("v_inv"), F.sum(F.expr("weight * g * (score - e)")).alias("gain"), F.count("*").alias("games"))
    return known.join(per, [*k, "entity"], "left").withColumn("games", F.coalesce("games", F.lit(0)))


def glicko_period(side: DataFrame, ratings: DataFrame, default=(1500.0, 350.0, 0.06), keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, entity, mu, phi, sigma, games) after one period; all games are read against ratings before it."""

    @pandas_udf("struct<mu:double,phi:double,sigma:double>")
    def rate(mu: pd.Series, phi: pd.Series, sigma: pd.Series, v_inv: pd.Series, gain: pd.Series) -> pd.DataFrame:
        rows = [stats.glicko_after(m, p, s, None if pd.isna(v) else v, g) for m, p, s, v, g in zip(mu, phi, sigma, v_inv, gain)]
        return pd.DataFrame(rows, columns=["mu", "phi", "sigma"])

    both = glicko_evidence(side, ratings, default, keys)
    return both.select(*keys, "entity", rate("mu", "phi", "sigma", "v_inv", "gain").alias("r"), "games").select(*keys, "entity", "r.mu", "r.phi", "r.sigma", "games")


def leaderboard(ratings: DataFrame) -> DataFrame:
    """Place by rating, then certainty, then id; with the rating drawn to the median by its deviation."""
    m = ratings.agg(F.median("mu").alias("median"))
    eff = F.col("median") + (F.col("mu") - F.col("median")) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("phi") / 350))
    return ratings.join(F.broadcast(m)).select("id", "mu", "phi", eff.alias("effective"), F.row_number().over(W.orderBy(F.desc("mu"), "phi", "id")).alias("place"))


def algorithm_standings(duels: DataFrame) -> DataFrame:
    """Wins, losses and ties per algorithm from (a, b, winner), with the exact sign test's p."""
    rows = F.explode(F.array(F.struct(F.col("a").alias("algo"), F.lit("a").alias("side")), F.struct(F.col("b").alias("algo"), F.lit("b").alias("side"))))
    per = duels.select(rows.alias("r"), "winner").groupBy("r.algo").agg(
        F.count_if(F.col("winner") == F.col("r.side")).alias("wins"), F.count_if((F.col("winner") != F.col("r.side")) & (F.col("winner") != "draw")).alias("losses"), F.count_if(F.col("winner") == "draw").alias("ties"), F.count("*").alias("judged")
    )

    @pandas_udf("double")
    def p(w: pd.Series, l: pd.Series) -> pd.Series:  # noqa: E741
        return pd.Series([stats.sign_test(int(a), int(b)) for a, b in zip(w, l)])

    return per.withColumn("p", p("wins", "losses"))


def interleave_standings(shown: DataFrame) -> DataFrame:
    """Slots, credits and rate per arm pair and arm, with the pair's Fisher p over credited and uncredited slots."""
    per = shown.groupBy("arm_a", "arm_b").agg(*(f(F.when(F.col("arm") == x, c)).alias(f"{n}_{x}") for x in "ab" for n, f, c in (("slots", F.count, F.lit(1)), ("credits", F.sum, F.col("credited")))))
    per = per.na.fill(0)

    @pandas_udf("double")
    def p(ca: pd.Series, sa: pd.Series, cb: pd.Series, sb: pd.Series) -> pd.Series:
        return pd.Series([stats.fisher(int(a), int(n - a), int(b), int(m - b)) for a, n, b, m in zip(ca, sa, cb, sb)])

    return per.withColumn("p", p("credits_a", "slots_a", "credits_b", "slots_b"))


def tag_learning(decided: DataFrame, work_tags: DataFrame, per_loser: int = 5) -> DataFrame:
    """(owner, tag, weight, n): +1 for tags only the winner carries, -1 for those only the loser does; shared tags cancel.

    decided: (owner, key, winner, loser); at most per_loser games of an owner count against one loser, earliest first.
    """
    d = decided.withColumn("rn", F.row_number().over(W.partitionBy("owner", "loser").orderBy("key"))).where(F.col("rn") <= per_loser)
    c = work_tags.select("work_id", "tag").distinct()
    side = lambda x, w: d.join(c.withColumnRenamed("work_id", x), x).select("owner", "key", "tag", F.lit(w).alias("w"))
    both = side("winner", 1).union(side("loser", -1)).groupBy("owner", "key", "tag").agg(F.sum("w").alias("w"), F.count("*").alias("c")).where("c = 1")
    return both.groupBy("owner", "tag").agg(F.avg("w").alias("weight"), F.count("*").alias("n"))


def team_drafts(lists: DataFrame, n: int) -> DataFrame:
    """Interleaved lists of many requests (request, a array<long>, b array<long>)."""

    def run(batches):
        for b in batches:
            out = [(r, k + 1, i, arm) for r, x, y in zip(b["request"], b["a"], b["b"]) for k, (i, arm) in enumerate(stats.team_draft(list(x), list(y), n, int(r)))]
            yield pd.DataFrame(out, columns=["request", "slot", "id", "arm"])

    return lists.mapInPandas(run, "request long, slot long, id long, arm string")


def bradley_terry(duels: DataFrame, prior: float = 1.0) -> DataFrame:
    """Strengths from (winner, loser, weight): pairs are summed on the cluster, the fit runs over the pair table of the entities."""
    pairs = duels.where("weight > 0").groupBy("winner", "loser").agg(F.sum("weight").alias("weight"))
    fit = stats.bradley_terry([(r["winner"], r["loser"], r["weight"]) for r in pairs.orderBy("winner", "loser").toLocalIterator()], prior)
    return duels.sparkSession.createDataFrame(sorted(fit.items()) or [], "entity long, strength double")

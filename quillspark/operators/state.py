"""State of readers and of the crawl as relations: taste vectors, stances, blocks, queues, arena logs. Updates are new relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# -- taste ----------------------------------------------------------------------------------------------------------


def _unit(df: DataFrame) -> DataFrame:
    n = df.groupBy("owner").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n")).where("n > 0")
    return df.join(n, "owner").select("owner", "tag", (F.col("weight") / F.col("n")).alias("weight"))


def owner_vector(profile: DataFrame, learned: DataFrame) -> DataFrame:
    """(owner, tag, weight): half of the profile and half of what was learned, each of unit length."""
    return _unit(profile).union(_unit(learned)).groupBy("owner", "tag").agg((F.sum("weight") / 2).alias("weight"))


def agreement_with(vectors: DataFrame, voters: DataFrame, owner: int | None) -> DataFrame:
    """(voter, agree): 1 without an owner and for the owner, 0 where either has no vector, else the cosine."""
    if owner is None:
        return voters.select("voter", F.lit(1.0).alias("agree"))
    mine = vectors.where(F.col("owner") == owner).select("tag", F.col("weight").alias("w0"))
    size = mine.agg(F.sqrt(F.sum(F.col("w0") ** 2)).alias("n0"))
    dot = vectors.join(F.broadcast(mine), "tag", "left").groupBy(F.col("owner").alias("voter")).agg(F.sum(F.col("weight") * F.col("w0")).alias("dot"), F.sqrt(F.sum(F.col("weight") ** 2)).alias("n"))
    out = voters.select("voter").join(dot, "voter", "left").join(F.broadcast(size))
    return out.select("voter", F.when(F.col("voter") == owner, 1.0).when((F.col("n") > 0) & (F.col("n0") > 0), F.coalesce(F.col("dot"), F.lit(0.0)) / (F.col("n") * F.col("n0"))).otherwise(0.0).alias("agree"))


def feedback_delta(rate: Column, polarity: Column, tags: Column) -> Column:
    """rate times polarity over the root of the number of tags, within -1..1; none without tags."""
    return F.when(tags > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rate * polarity / F.sqrt(tags)))).otherwise(0.0)


def top_weights(weights: DataFrame, k: int) -> DataFrame:
    """(owner, tag, weight, place): an owner's k weights of largest size."""
    w = W.partitionBy("owner").orderBy(F.desc(F.round(F.abs("weight"), 9)), "tag")
    return weights.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def liked_and_disliked(weights: DataFrame, k: int) -> DataFrame:
    """(owner, side, tag, place): an owner's k most liked and k most disliked tags."""
    side = F.when(F.col("weight") > 0, "liked").when(F.col("weight") < 0, "disliked")
    w = W.partitionBy("owner", "side").orderBy(F.desc(F.round(F.abs("weight"), 9)), "tag")
    return weights.withColumn("side", side).where("side is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("owner", "side", "tag", "place")


def import_taste(stored: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """Weights (owner, tag, weight) after an import: new ones win; replace drops all others of the owners imported."""
    keep = stored.join(new.select("owner").distinct(), "owner", "left_anti") if replace else stored.join(new, ["owner", "tag"], "left_anti")
    return keep.select("owner", "tag", "weight").unionByName(new.select("owner", "tag", "weight"))


def forget(owners: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The tables without the rows of the owners (owner)."""
    return [t.join(F.broadcast(owners.select("owner").distinct()), "owner", "left_anti") for t in tables]


def blocked_now(log: DataFrame) -> DataFrame:
    """(owner, tag) blocked after a log of (owner, tag, action, at, key): the latest action of each counts."""
    w = W.partitionBy("owner", "tag").orderBy(F.desc("at"), F.desc("key"))
    return log.withColumn("rn", F.row_number().over(w)).where("rn = 1 and action = 'block'").select("owner", "tag")


def stance_counts(log: DataFrame) -> DataFrame:
    """(owner, likes, dislikes) of the stances that stand: the latest per owner and work. log: (owner, work, polarity, at, key)."""
    w = W.partitionBy("owner", "work").orderBy(F.desc("at"), F.desc("key"))
    now = log.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return now.groupBy("owner").agg(F.count_if(F.col("polarity") > 0).alias("likes"), F.count_if(F.col("polarity") < 0).alias("dislikes"))


# -- arena ----------------------------------------------------------------------------------------------------------


def canonical_pairs(log: DataFrame) -> DataFrame:
    """A log of shown pairs with the smaller entity first, the choice turned with it."""
    turned = F.col("a") > F.col("b")
    choice = F.when(turned & (F.col("choice") == "a"), "b").when(turned & (F.col("choice") == "b"), "a").otherwise(F.col("choice"))
    return log.withColumn("low", F.least("a", "b")).withColumn("high", F.greatest("a", "b")).withColumn("choice", choice).drop("a", "b")


def seen_pairs(log: DataFrame, most: int = 4000) -> DataFrame:
    """(owner, low, high): every owner's distinct pairs among the latest `most` shown, never to be shown again."""
    w = W.partitionBy("owner").orderBy(F.desc("key"))
    return log.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select("owner", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()


def arena_stats(log: DataFrame) -> DataFrame:
    """One row: pairs shown, judged, left undecided, and open."""
    return log.agg(F.count("*").alias("shown"), F.count_if(F.col("choice").isin("a", "b")).alias("judged"), F.count_if(F.col("choice") == "neither").alias("neither"), F.count_if(F.col("choice").isNull()).alias("open"))


def latest_open(log: DataFrame) -> DataFrame:
    """(owner, kind, key): the latest pair of an owner and kind, where it is still open."""
    w = W.partitionBy("owner", "kind").orderBy(F.desc("key"))
    return log.withColumn("rn", F.row_number().over(w)).where("rn = 1 and choice is null").select("owner", "kind", "key")


def judged_after(log: DataFrame, since, most: int = 20_000) -> DataFrame:
    """Judged pairs beyond a watermark, in order of key, `most` at a time: the next call goes on from the last."""
    return log.where((F.col("judged_at") > F.lit(since)) & F.col("choice").isNotNull()).orderBy("key").limit(most)


def history(rows: DataFrame, entity: str, at: str, most: int) -> DataFrame:
    """Each entity's latest `most` rows, oldest first (place 1)."""
    w = W.partitionBy(entity)
    kept = rows.withColumn("rn", F.row_number().over(w.orderBy(F.desc(at)))).where(F.col("rn") <= most)
    return kept.withColumn("place", F.row_number().over(w.orderBy(at))).drop("rn")


def rejected(log: DataFrame) -> DataFrame:
    """(owner, work): what a judged pair passed over, both sides of `neither`."""
    lost = F.when(F.col("choice") == "a", F.array("b")).when(F.col("choice") == "b", F.array("a")).when(F.col("choice") == "neither", F.array("a", "b"))
    return log.select("owner", F.explode(lost).alias("work"))


def stamped(judged: DataFrame, agreement: DataFrame) -> DataFrame:
    """Judgements with the voter's agreement as it stood when they were made; unknown voters count nothing. Both: voter."""
    return judged.join(agreement, "voter", "left").withColumn("agree", F.coalesce("agree", F.lit(0.0)))


# -- crawl and jobs ----------------------------------------------------------------------------------------------------


def requeued(queue: DataFrame, before) -> DataFrame:
    """The queue (url, state, taken_at) with what was taken before a time and never finished set back to pending."""
    stale = (F.col("state") == "taken") & (F.col("taken_at") < F.lit(before))
    return queue.withColumns({"state": F.when(stale, "pending").otherwise(F.col("state")), "taken_at": F.when(stale, None).otherwise(F.col("taken_at"))})


def parked(queue: DataFrame, most: int) -> DataFrame:
    """The queue with what failed `most` times or more parked."""
    return queue.withColumn("state", F.when((F.col("state") != "done") & (F.col("attempts") >= most), "parked").otherwise(F.col("state")))


def marks_since(marks: DataFrame, since) -> DataFrame:
    return marks.where(F.col("at") > F.lit(since)).groupBy("owner").agg(F.count("*").alias("marks"))


def read_among(marks: DataFrame, works: DataFrame) -> DataFrame:
    """(owner, work): which of a list of works (work) each owner has marked."""
    return marks.join(works.select("work").distinct(), "work", "left_semi").select("owner", "work").distinct()


def due(refreshed: DataFrame, kinds: DataFrame, now, ttl_seconds: int) -> DataFrame:
    """(kind) whose candidates were never drawn, or longer ago than their time to live; an empty draw counts as one."""
    last = refreshed.groupBy("kind").agg(F.max("at").alias("at"))
    old = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("at") > ttl_seconds
    return kinds.join(last, "kind", "left").where(F.col("at").isNull() | old).select("kind")


def replaced(stored: DataFrame, new: DataFrame, kinds: DataFrame) -> DataFrame:
    """Candidates (kind, id, ...) with those of the given kinds replaced, also by none."""
    return stored.join(F.broadcast(kinds.select("kind").distinct()), "kind", "left_anti").unionByName(new)


def latest_run(rows: DataFrame, run: str) -> DataFrame:
    """The rows of the latest run."""
    return rows.join(F.broadcast(rows.agg(F.max(run).alias(run))), run)


def imported(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored and the rows of new whose keys it lacks, once each."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored, keys, "left_anti"))


def stamp(works: DataFrame, updated: str, seen: str) -> DataFrame:
    """One row: the newest change of the corpus."""
    return works.agg(F.max(F.coalesce(updated, seen)).alias("stamp"))


def quota(found: DataFrame, cap: int) -> DataFrame:
    """(name, quota): the larger of a universe's counts (name, works), capped."""
    return found.groupBy("name").agg(F.least(F.max("works"), F.lit(cap)).alias("quota"))


def parsed_time(s: Column) -> Column:
    """A state table's time in any of its layouts; null where none fits."""
    iso = F.regexp_replace(F.trim(s), r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(\.\d{1,6})?\d*(Z|[+-]\d{2}:?\d{2})?$", "$1 $2$3$4")
    return F.coalesce(iso.try_cast("timestamp"), F.trim(s).try_cast("date").cast("timestamp"))

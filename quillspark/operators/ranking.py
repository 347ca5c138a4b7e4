"""Ranking signals, their composition with evidence, candidate pools, re-ranking and corpus-query modes.

A signal is a nullable column over candidates: null is "no opinion", and a candidate without any opinion is dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import scoring as fn
from quillspark.operators import corpus as op

#: The default weight of each signal.
DEFAULT_TUNE = {
    "tag_overlap": 0.22, "neighbourhood": 0.30, "quality": 0.09, "recency": 0.09, "popularity": 0.09, "embedding": 0.10, "collab": 0.16, "peer_rating": 0.11,
    "owner_taste": 0.06, "session_taste": 0.14, "idf_overlap": 0.12, "tag_npmi": 0.0, "latent": 0.0, "seed_agreement": 0.1, "length_fit": 0.08, "walk": 0.06, "summary_style": 0.1911,
}


# -- signals over (id) candidates and (seed) seeds ---------------------------------------------------------------------


def tag_sets(work_tags: DataFrame) -> DataFrame:
    return op.carried(work_tags).groupBy("work_id").agg(F.sort_array(F.collect_list("tag")).alias("tags"))


def tag_overlap(work_tags: DataFrame, seeds: DataFrame) -> DataFrame:
    """Best Jaccard similarity of a work's tags with those of any seed."""
    c = op.carried(work_tags)
    n = c.groupBy("work_id").agg(F.count("*").alias("n"))
    s = c.join(F.broadcast(seeds.select(F.col("seed").alias("work_id"))), "work_id").select(F.col("work_id").alias("seed"), "tag")
    ns = s.groupBy("seed").agg(F.count("*").alias("ns"))
    both = c.join(F.broadcast(s), "tag").where("work_id <> seed").groupBy("work_id", "seed").agg(F.count("*").alias("c"))
    j = both.join(n, "work_id").join(F.broadcast(ns), "seed").withColumn("v", F.col("c") / (F.col("n") + F.col("ns") - F.col("c")))
    return j.groupBy(F.col("work_id").alias("id")).agg(F.max("v").alias("value"))


def neighbours(work_tags: DataFrame, works: DataFrame) -> DataFrame:
    """(src, dst, co, pmi, npmi) of every co-occurring pair in both directions."""
    df, n = op.doc_frequency(work_tags), works.agg(F.count("*").alias("n"))
    e = op.symmetric(op.tag_pairs(work_tags)).join(df.select(F.col("tag").alias("src"), F.col("df").alias("fs")), "src").join(df.select(F.col("tag").alias("dst"), F.col("df").alias("fd")), "dst").join(F.broadcast(n))
    return e.withColumn("pmi", F.round(fn.pmi(F.col("co"), F.col("fs"), F.col("fd"), F.col("n")), 9)).withColumn("npmi", F.round(fn.npmi(F.col("co"), F.col("fs"), F.col("fd"), F.col("n")), 9))


def seed_tags(work_tags: DataFrame, seeds: DataFrame) -> DataFrame:
    return op.carried(work_tags).join(F.broadcast(seeds.select(F.col("seed").alias("work_id"))), "work_id").select("tag").distinct()


def neighbourhood_pmi(works: DataFrame, work_tags: DataFrame, seeds: DataFrame, top: int = 24, of: DataFrame | None = None) -> DataFrame:
    """Votes of the best positive neighbours of each seed tag, summed over a work's tags and squashed.

    of, here and below: the rows of work_tags of the works to score, if not all; what is counted stays counted over all.
    """
    e = neighbours(work_tags, works).join(F.broadcast(seed_tags(work_tags, seeds).withColumnRenamed("tag", "src")), "src").where("pmi > 0")
    e = e.withColumn("rn", F.row_number().over(W.partitionBy("src").orderBy(F.desc("pmi"), "dst"))).where(F.col("rn") <= top)
    votes = e.groupBy(F.col("dst").alias("tag")).agg(F.sum("pmi").alias("vote"))
    per = op.carried(work_tags if of is None else of).join(votes, "tag", "left").groupBy(F.col("work_id").alias("id")).agg(F.sum("vote").alias("s"), F.count("*").alias("n"))
    x = F.col("s") / F.sqrt("n")
    return per.where("s is not null").select("id", (x / (x + 100)).alias("value"))


def neighbourhood_npmi(works: DataFrame, work_tags: DataFrame, seeds: DataFrame) -> DataFrame:
    """Per tag its best nPMI with a seed tag, averaged over all tags of a work."""
    e = neighbours(work_tags, works).join(F.broadcast(seed_tags(work_tags, seeds).withColumnRenamed("tag", "src")), "src").where("npmi > 0")
    votes = e.groupBy(F.col("dst").alias("tag")).agg(F.max("npmi").alias("vote"))
    per = op.carried(work_tags).join(votes, "tag", "left").groupBy(F.col("work_id").alias("id")).agg(F.sum("vote").alias("s"), F.count("*").alias("n"))
    return per.where("s is not null").select("id", (F.col("s") / F.col("n")).alias("value"))


def idf_weights(works: DataFrame, work_tags: DataFrame) -> DataFrame:
    n = works.agg(F.count("*").alias("n"))
    return op.doc_frequency(work_tags).join(F.broadcast(n)).select("tag", "df", "n", fn.idf(F.col("df"), F.col("n")).alias("idf"))


def idf_overlap(works: DataFrame, work_tags: DataFrame, seeds: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """IDF-weighted Jaccard similarity with the best seed. of holds the seeds too."""
    c = op.carried(work_tags if of is None else of).join(idf_weights(works, work_tags).select("tag", "idf"), "tag")
    mass = c.groupBy("work_id").agg(F.sum("idf").alias("m"))
    s = c.join(F.broadcast(seeds.select(F.col("seed").alias("work_id"))), "work_id").select(F.col("work_id").alias("seed"), "tag")
    both = c.join(F.broadcast(s), "tag").where("work_id <> seed").groupBy("work_id", "seed").agg(F.sum("idf").alias("b"))
    j = both.join(mass, "work_id").join(mass.select(F.col("work_id").alias("seed"), F.col("m").alias("ms")), "seed")
    union = F.col("m") + F.col("ms") - F.col("b")
    return j.where(union > 0).groupBy(F.col("work_id").alias("id")).agg(F.max(F.col("b") / union).alias("value"))


def tag_npmi(works: DataFrame, work_tags: DataFrame, seeds: DataFrame) -> DataFrame:
    """Mean over a work's tags of its normalised IDF if a seed carries it, else its best association of two works or more."""
    st = seed_tags(work_tags, seeds)
    e = neighbours(work_tags, works).where("co >= 2").join(F.broadcast(st.withColumnRenamed("tag", "src")), "src")
    assoc = e.groupBy(F.col("dst").alias("tag")).agg(F.max("npmi").alias("assoc"))
    t = idf_weights(works, work_tags).join(assoc, "tag", "left").join(st.withColumn("shared", F.lit(True)), "tag", "left")
    value = F.greatest(F.when(F.col("shared"), F.col("idf") / F.log("n")).otherwise(0.0), F.coalesce("assoc", F.lit(0.0)))
    return op.apart(op.carried(work_tags)).join(t.select("tag", value.alias("v")), "tag").groupBy(F.col("work_id").alias("id")).agg(F.avg("v").alias("value"))


def seed_agreement(works: DataFrame, work_tags: DataFrame, seeds: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Mean over seeds of the share of a seed's IDF mass that a work matches; needs two seeds with mass. of holds the seeds too."""
    c = op.carried(work_tags if of is None else of).join(idf_weights(works, work_tags).select("tag", "idf"), "tag")
    s = c.join(F.broadcast(seeds.select(F.col("seed").alias("work_id"))), "work_id").select(F.col("work_id").alias("seed"), "tag", "idf")
    mass = s.groupBy("seed").agg(F.sum("idf").alias("mass")).where("mass > 0")
    n = mass.agg(F.count("*").alias("n_seeds"))
    hit = c.select("work_id", "tag").join(F.broadcast(s), "tag").groupBy("work_id", "seed").agg(F.sum("idf").alias("hit")).join(F.broadcast(mass), "seed")
    out = hit.groupBy(F.col("work_id").alias("id")).agg(F.sum(F.col("hit") / F.col("mass")).alias("s")).join(F.broadcast(n)).where("n_seeds >= 2")
    return out.select("id", (F.col("s") / F.col("n_seeds")).alias("value"))


def co_similarity(interactions: DataFrame, gate: int, prior: float = 100.0) -> DataFrame:
    """(a, b, sim): co/sqrt(na*nb), shrunk by co/(co+prior)."""
    n = op.bookmark_counts(interactions)
    p = op.co_bookmarks(interactions, gate).join(n.select(F.col("work_id").alias("a"), F.col("readers").alias("na")), "a").join(n.select(F.col("work_id").alias("b"), F.col("readers").alias("nb")), "b")
    return p.select("a", "b", "co", (F.col("co") / F.sqrt(F.col("na") * F.col("nb")) * F.col("co") / (F.col("co") + prior)).alias("sim"))


def co_similarity_of(interactions: DataFrame, seeds: DataFrame, gate: int, prior: float = 100.0) -> DataFrame:
    """(seed, other, co, sim) for the seeds only: no pair table of the whole corpus."""
    n = op.bookmark_counts(interactions)
    s = op.shared_readers(interactions, seeds).where(F.col("shared") >= gate)
    s = s.join(n.select(F.col("work_id").alias("seed"), F.col("readers").alias("na")), "seed").join(n.select(F.col("work_id").alias("other"), F.col("readers").alias("nb")), "other")
    return s.select("seed", "other", F.col("shared").alias("co"), (F.col("shared") / F.sqrt(F.col("na") * F.col("nb")) * F.col("shared") / (F.col("shared") + prior)).alias("sim"))


def collab_votes(interactions: DataFrame, seeds: DataFrame, gate: int, top: int) -> DataFrame:
    """Similarities of each seed's best neighbours, summed; seeds get none."""
    s = co_similarity_of(interactions, seeds, gate).withColumn("sim", F.round("sim", 9))
    s = s.withColumn("rn", F.row_number().over(W.partitionBy("seed").orderBy(F.desc("sim"), "other"))).where(F.col("rn") <= top)
    return s.join(F.broadcast(seeds.withColumnRenamed("seed", "other")), "other", "left_anti").groupBy(F.col("other").alias("id")).agg(F.sum("sim").alias("vote"))


def collab(works: DataFrame, interactions: DataFrame, seeds: DataFrame, gate: int = 1, top: int = 50, votes: DataFrame | None = None) -> DataFrame:
    """Votes over the largest vote; unseen works score 0; without any vote there is no opinion. votes: if they are at hand."""
    v = collab_votes(interactions, seeds, gate, top) if votes is None else votes
    most = v.agg(F.max("vote").alias("most"))
    out = works.select("id").join(v, "id", "left").join(F.broadcast(most))
    return out.where("most is not null").select("id", F.least(F.lit(1.0), F.coalesce("vote", F.lit(0.0)) / F.col("most")).alias("value"))


def owner_taste(work_tags: DataFrame, weights: DataFrame) -> DataFrame:
    """Share of a work's absolute tag weight that is positive; no overlap scores 0. weights: (tag, weight)."""
    per = op.carried(work_tags).join(weights, "tag", "left").groupBy(F.col("work_id").alias("id")).agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("p"), F.sum(F.abs("weight")).alias("a"))
    return per.select("id", F.when(F.col("a") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") / F.col("a")))).otherwise(0.0).alias("value"))


def session_taste(work_tags: DataFrame, learned: DataFrame) -> DataFrame:
    """Sum of w*n/(n+1) over matched tags, clamped to one; no match is no opinion. learned: (tag, weight, n)."""
    per = op.carried(work_tags).join(learned, "tag").groupBy(F.col("work_id").alias("id")).agg(F.sum(F.col("weight") * F.col("n") / (F.col("n") + 1)).alias("s"))
    return per.select("id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s"))).alias("value"))


def length_fit(works: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ratio of a work's length to the median length of the seeds (mean of the middle two)."""
    m = works.join(F.broadcast(seeds.select(F.col("seed").alias("id"))), "id").where("word_count > 0").agg(F.median("word_count").alias("median"))
    return works.join(F.broadcast(m)).select("id", fn.length_fit(F.col("word_count"), F.col("median")).alias("value")).where("value is not null")


def peer_rating(works: DataFrame, ratings: DataFrame) -> DataFrame:
    """(effective - median)/150, clamped; unrated works score 0; without ratings there is no opinion. ratings: (id, mu, phi)."""
    m = ratings.agg(F.median("mu").alias("median"))
    out = works.select("id").join(op.apart(ratings), "id", "left").join(F.broadcast(m)).where("median is not null")
    v = (fn.effective_rating(F.col("mu"), F.col("phi"), F.col("median")) - F.col("median")) / 150
    return out.select("id", F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)), F.lit(0.0)).alias("value"))


def mean_vectors(work_tags: DataFrame, tag_vectors: DataFrame) -> DataFrame:
    """(work_id, v): mean of the vectors of a work's tags. tag_vectors: (tag, v), broadcast: as many as there are tags with vectors.

    Tags are dealt by work before they get their vectors, so that no vector is shuffled and no work broadcast.
    """
    t = tag_vectors.select("tag", "v", F.size("v").alias("width"), F.exists("v", lambda x: x.isNull()).alias("holes")).where("width > 0")
    e = work_tags.groupBy("work_id").agg(F.collect_set("tag").alias("tags")).select("work_id", F.explode("tags").alias("tag")).join(F.broadcast(t), "tag")
    e = e.groupBy("work_id").agg(F.collect_list("v").alias("vs"), F.min("width").alias("low"), F.max("width").alias("high"), F.max("holes").alias("holes"))
    wide = F.transform(F.element_at("vs", 1), lambda x: x.cast("double"))
    total = F.aggregate(F.slice("vs", 2, F.size("vs")), wide, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    mean = lambda xs: F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs))
    ragged = F.transform(F.sequence(F.lit(0), F.col("high") - 1), lambda i: mean(F.filter(F.transform("vs", lambda v: F.get(v, i)), lambda x: x.isNotNull())))
    return e.select("work_id", F.when((F.col("low") == F.col("high")) & ~F.col("holes"), F.transform(total, lambda x: x / F.size("vs"))).otherwise(ragged).alias("v"))


def taught_by(work_tags: DataFrame, tag_vectors: DataFrame, seeds: DataFrame) -> DataFrame:
    """The embedding signal from tags' vectors; the seeds' centroids are made from their own tags alone."""
    own = work_tags.join(F.broadcast(seeds.select(F.col("seed").alias("work_id"))), "work_id", "left_semi")
    return embedding(mean_vectors(work_tags, tag_vectors), seeds, mean_vectors(own, tag_vectors))


def embedding(centroids: DataFrame, seeds: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Cosine with the mean of the seeds' centroids (own, if they are at hand); not positive is no opinion."""
    s = (centroids if own is None else own).join(F.broadcast(seeds.select(F.col("seed").alias("work_id"))), "work_id").select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("x"))
    s = s.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda z: z["x"]).alias("sv"))
    out = centroids.join(F.broadcast(s)).select(F.col("work_id").alias("id"), fn.cosine(F.col("v"), F.col("sv")).alias("value"))
    return out.where("value > 0")


def walk_signal(work_tags: DataFrame, mass: DataFrame) -> DataFrame:
    """Share of the walk's mass (tag, mass) on a work's tags."""
    total = mass.agg(F.sum("mass").alias("total"))
    per = op.carried(work_tags).join(mass, "tag").groupBy(F.col("work_id").alias("id")).agg(F.sum("mass").alias("m"))
    return per.join(F.broadcast(total)).where("total > 0").select("id", (F.col("m") / F.col("total")).alias("value"))


def summary_style(docs: DataFrame, text: Column, seeds: DataFrame, least: float = 0.02) -> DataFrame:
    """IDF cosine of a text's terms with the union of the seeds' terms (docs: id, text); below `least` is no opinion."""
    terms = docs.select("id", F.explode(fn.summary_terms(text)).alias("term"))
    n = docs.agg(F.count("*").alias("n"))
    df = op.term_frequency(text, docs).join(F.broadcast(n)).select("term", fn.idf(F.col("df"), F.col("n")).alias("w"))
    t = terms.join(df, "term")
    s = t.join(F.broadcast(seeds.select(F.col("seed").alias("id"))), "id").select("term", "w").distinct()
    norm = s.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("ns"))
    both = t.join(F.broadcast(s.select("term", F.lit(1).alias("hit"))), "term", "left").groupBy("id").agg(F.sum(F.when(F.col("hit") == 1, F.col("w") * F.col("w"))).alias("d"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nd"))
    out = both.join(F.broadcast(norm)).select("id", (F.col("d") / (F.col("nd") * F.col("ns"))).alias("value"))
    return out.where(F.col("value") >= least)


# -- composition -------------------------------------------------------------------------------------------------------


def retuned(changes: dict[str, float]) -> tuple[dict[str, float], list[str]]:
    """The default weights with changes, and the names that no signal has."""
    return DEFAULT_TUNE | {k: v for k, v in changes.items() if k in DEFAULT_TUNE}, sorted(set(changes) - set(DEFAULT_TUNE))


def renormalised(tune: dict[str, float], dropped: set[str]) -> dict[str, float]:
    """Weights of the signals left, scaled to the sum before."""
    kept = {k: v for k, v in tune.items() if k not in dropped}
    scale = sum(tune.values()) / sum(kept.values()) if sum(kept.values()) else 0.0
    return {k: v * scale for k, v in kept.items()}


def compose(candidates: DataFrame, signals: dict[str, DataFrame | Callable[[], DataFrame]], tune: dict[str, float]) -> DataFrame:
    """(id, score, evidence): weighted sum of the opinions; evidence by weight times value.

    As in the original, a signal of weight zero is not run: it gives no score, no evidence and no opinion. A signal that costs
    work before it is read (training) is given as a function, called only if it has a weight.
    """
    names = [n for n in signals if tune.get(n)]
    if not names:
        return candidates.where("false").select("id", F.lit(0.0).alias("score"), F.array().cast("array<struct<signal:string,value:double,weight:double>>").alias("evidence"))
    out = candidates.select("id")
    for name in names:
        s = signals[name]() if callable(signals[name]) else signals[name]
        out = out.join(s.select("id", F.col("value").alias(f"s_{name}")), "id", "left")
    parts = [F.coalesce(F.col(f"s_{n}") * tune.get(n, 0.0), F.lit(0.0)) for n in names]
    opinions = reduce(lambda a, b: a + b, [F.col(f"s_{n}").isNotNull().cast("int") for n in names])
    proof = F.array(*(F.struct(F.lit(n).alias("signal"), F.col(f"s_{n}").alias("value"), F.lit(tune.get(n, 0.0)).alias("weight")) for n in names))
    held = F.filter(proof, lambda e: e["value"].isNotNull())
    order = F.transform(F.array_sort(F.transform(held, lambda e: F.struct((-e["value"] * e["weight"]).alias("k"), e["signal"].alias("signal"), e["value"].alias("value"), e["weight"].alias("weight")))), lambda e: F.struct(e["signal"], e["value"], e["weight"]))
    return out.where(opinions > 0).select("id", reduce(lambda a, b: a + b, parts).alias("score"), order.alias("evidence"))


def degraded(candidates: DataFrame, signals: dict[str, DataFrame]) -> DataFrame:
    """Names of signals that have no opinion on any candidate."""
    rows = None
    for name, s in signals.items():
        one = s.join(candidates.select("id"), "id", "left_semi").agg(F.count("*").alias("n")).where("n = 0").select(F.lit(name).alias("signal"))
        rows = one if rows is None else rows.union(one)
    return rows


def mmr(ranked: DataFrame, k: int = 20, lam: float = 0.75, per_group: int = 0, duplicate: float = 1.01) -> DataFrame:
    """Greedy re-ranking of each request's list (request, id, score, tags, grp), scores scaled to the best, or to a column top.

    A candidate's worth is lam*score - (1-lam)*largest tag similarity to what is chosen. per_group bounds a group's places (0:
    no bound); candidates as similar as `duplicate` to a chosen one are left out. Lists are bounded: requests run side by side.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        tags = [set(t) for t in g["tags"]]
        top = (g["top"][0] if "top" in g else g["score"].abs().max()) or 1.0
        worth, near = (g["score"] / top).tolist(), [0.0] * len(g)
        chosen, used, left = [], {}, set(range(len(g)))
        while left and len(chosen) < k:
            best = min(left, key=lambda i: (-(lam * worth[i] - (1 - lam) * near[i]), g["id"][i]))
            left.discard(best)
            if near[best] >= duplicate or per_group and used.get(g["grp"][best], 0) >= per_group:
                continue
            used[g["grp"][best]] = used.get(g["grp"][best], 0) + 1
            chosen.append(best)
            for i in left:
                union = len(tags[i] | tags[best])
                near[i] = max(near[i], len(tags[i] & tags[best]) / union if union else 0.0)
        out = g.loc[chosen, ["request", "id", "score"]].copy()
        out["place"] = range(1, len(out) + 1)
        return out

    return ranked.groupBy("request").applyInPandas(run, "request long, id long, score double, place long")


# -- corpus-query modes ------------------------------------------------------------------------------------------------


def tag_neighbours(works: DataFrame, work_tags: DataFrame, seed: DataFrame, limit: int = 50, gate: int = 1) -> DataFrame:
    """Tags that stand with one seed tag (one row, tag) more often than chance, by PMI.

    First the limit*4 most frequent companions, then those of positive PMI, best first.
    """
    c = op.carried(work_tags)
    df, n = op.doc_frequency(work_tags), works.agg(F.count("*").alias("n"))
    seed = F.broadcast(seed.select(F.col("tag").alias("seed")))
    of = c.join(seed, c["tag"] == F.col("seed")).select("work_id", "seed")
    co = c.join(of.select("work_id"), "work_id", "left_semi").join(seed, c["tag"] != F.col("seed")).groupBy("tag").agg(F.count("*").alias("co")).where(F.col("co") >= gate)
    co = co.orderBy(F.desc("co"), "tag").limit(limit * 4)
    size = of.agg(F.count("*").alias("n_seed"))
    out = co.join(df, "tag").join(F.broadcast(size)).join(F.broadcast(n)).withColumn("expected", F.col("n_seed") * F.col("df") / F.col("n"))
    out = out.withColumn("pmi", F.round(F.log(F.col("co") / F.col("expected")), 9)).where("pmi > 0")
    return out.orderBy(F.desc("pmi"), F.desc("co"), "tag").limit(limit).select("tag", "co", "df", "pmi")


def head_tag(work_tags: DataFrame, kind: str) -> DataFrame:
    return work_tags.where(F.col("tag_type") == kind).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(1).select("tag")


def fandom_ranking(works: DataFrame, work_tags: DataFrame, kind: str, seed_tags: DataFrame, gate: int, least_works: int = 2, literal: bool = False) -> DataFrame:
    """Universes (tags of one type) by how much more often their works carry a seed tag than works at large.

    literal=True counts only rows in which the universe's own tag is a seed tag.
    """
    u = work_tags.where(F.col("tag_type") == kind).select("work_id", "tag").distinct()
    n = works.agg(F.count("*").alias("n"))
    hit = op.carried(work_tags).join(F.broadcast(seed_tags.select("tag")), "tag").select("work_id").distinct()
    total = hit.agg(F.count("*").alias("hits"))
    size = u.groupBy("tag").agg(F.count("*").alias("works"))
    own = u.join(F.broadcast(seed_tags.select("tag")), "tag", "left_semi") if literal else u.join(hit, "work_id", "left_semi")
    co = own.groupBy("tag").agg(F.count("*").alias("co"))
    out = size.join(co, "tag", "left").withColumn("co", F.coalesce("co", F.lit(0))).join(F.broadcast(n)).join(F.broadcast(total))
    if literal:
        return out.where(F.col("works") >= gate).select("tag", "works", "co", (F.col("co") / F.col("works")).alias("lift"))
    out = out.where((F.col("co") >= gate) & (F.col("works") >= least_works))
    return out.select("tag", "works", "co", ((F.col("co") / F.col("works")) / (F.col("hits") / F.col("n"))).alias("lift"))


def underrated(works: DataFrame, limit: int, least_hits: int = 1, best_last: bool = False) -> DataFrame:
    """The `limit` lowest (kudos+bookmarks)/hits, shown highest first; best_last: the highest instead."""
    r = F.round((F.col("kudos") + F.coalesce("bookmarks", F.lit(0))) / F.col("hits"), 9)
    w = works.where(F.col("hits") >= least_hits).withColumn("ratio", r)
    w = w.orderBy((F.desc if best_last else F.asc)("ratio"), F.desc("kudos"), "id").limit(limit)
    return w.withColumn("place", F.row_number().over(W.orderBy(F.desc("ratio"), F.desc("kudos"), "id")))


def surprise(works: DataFrame, work_tags: DataFrame, least_tags: int, start: int, span: int = 512) -> DataFrame:
    """The first work from `start` on, within `span` ids, that has enough tags; else the lowest such id."""
    n = op.carried(work_tags).groupBy(F.col("work_id").alias("id")).agg(F.count("*").alias("tags")).where(F.col("tags") >= least_tags)
    ok = works.join(n, "id").agg(F.min(F.when((F.col("id") >= start) & (F.col("id") < start + span), F.col("id"))).alias("near"), F.min("id").alias("low"))
    return ok.select(F.coalesce("near", "low").alias("id"))


def tag_trend(works: DataFrame, work_tags: DataFrame, seed: DataFrame, windows=(90, 180, 365, 730, 1460, 3650), gate: int = 3) -> DataFrame:
    """Growth of each tag's share among the seed's works, against the growth of the corpus, in the narrowest window that is full.

    A window is full with max(5, min(200, n/10)) of the seed's works; the newest work is the clock.
    """
    c = op.carried(work_tags)
    dated = works.where("update_date is not null").select(F.col("id").alias("work_id"), "update_date")
    clock = dated.agg(F.max("update_date").alias("now"), F.count("*").alias("n_all"))
    own = c.join(F.broadcast(seed.select("tag")), "tag", "left_semi").select("work_id").join(dated, "work_id").join(F.broadcast(clock)).withColumn("age", F.date_diff("now", "update_date"))
    need = own.agg(F.count("*").alias("n"), *(F.count_if(F.col("age") < w).alias(f"w{w}") for w in windows))
    floor = F.greatest(F.lit(5), F.least(F.lit(200), F.floor(F.col("n") / 10)))
    pick = F.coalesce(*(F.when(F.col(f"w{w}") >= floor, F.lit(w)) for w in windows), F.lit(windows[-1]))
    window = need.select(pick.alias("window"))
    all_ = dated.join(F.broadcast(clock)).join(F.broadcast(window)).agg(F.count_if(F.date_diff("now", "update_date") < F.col("window")).alias("all_new"), F.count("*").alias("all_total"), F.first("window").alias("window"))
    own = own.select("work_id", "age")
    pair = c.join(F.broadcast(seed.select("tag")), "tag", "left_anti").join(own, "work_id").join(F.broadcast(window))
    pair = pair.groupBy("tag").agg(F.count("*").alias("co"), F.count_if(F.col("age") < F.col("window")).alias("co_new")).where(F.col("co") >= gate)
    growth = (F.col("co_new") / F.col("co")) / (F.col("all_new") / F.col("all_total"))
    return pair.join(F.broadcast(all_)).where("all_new > 0").select("tag", "window", "co", "co_new", growth.alias("growth"))


def tag_gap(works: DataFrame, work_tags: DataFrame, seed: DataFrame, hood: int = 30, gate: int = 20, seed_least: int = 25, least_works: int = 50, candidates: int = 150, prior: float = 100.0, limit: int = 20) -> DataFrame:
    """Tags that the seed's surroundings carry but the seed itself lacks.

    The neighbourhood is the `hood` tags of highest lift with the seed and at least `gate` works in common; hood works carry
    one of them and not the seed. Candidates stand outside it, with least_works works and `gate` hood works or more, the
    best by their share of works in the hood. Enrichment = (support/hood works)/(works/N) is shrunk by support/(support +
    prior); gap = (shrunk - 1)(1 - lift), kept where lift < 1 < shrunk. A seed of fewer than seed_least works has no gaps.
    """
    c = op.carried(work_tags)
    n = works.agg(F.count("*").alias("n"))
    df = op.doc_frequency(work_tags)
    seed_name = F.broadcast(seed.select(F.col("tag").alias("seed")))
    own = c.join(seed_name, F.col("tag") == F.col("seed"), "left_semi").select("work_id")
    size = own.agg(F.count("*").alias("ns")).where(F.col("ns") >= seed_least)
    co = c.join(own, "work_id", "left_semi").groupBy("tag").agg(F.count("*").alias("co"))
    lift = F.round(F.col("co") * F.col("n") / (F.col("ns") * F.col("df")), 9)
    stats = df.join(co, "tag", "left").join(F.broadcast(size)).join(F.broadcast(n)).join(seed_name, F.col("tag") != F.col("seed")).withColumn("co", F.coalesce("co", F.lit(0))).withColumn("lift", lift)
    near = stats.where(F.col("co") >= gate).orderBy(F.desc("lift"), "tag").limit(hood).select("tag")
    hood_works = c.join(F.broadcast(near), "tag", "left_semi").select("work_id").distinct().join(own, "work_id", "left_anti")
    nh = hood_works.agg(F.count("*").alias("nh"))
    there = c.join(hood_works, "work_id", "left_semi").groupBy("tag").agg(F.count("*").alias("support"))
    out = there.join(stats, "tag").join(F.broadcast(near), "tag", "left_anti").where((F.col("df") >= least_works) & (F.col("support") >= gate))
    out = out.orderBy(F.desc(F.round(F.col("support") / F.col("df"), 9)), "tag").limit(candidates).join(F.broadcast(nh))
    enriched = (F.col("support") / F.col("nh")) / (F.col("df") / F.col("n"))
    shrunk = 1 + (enriched - 1) * F.col("support") / (F.col("support") + prior)
    out = out.withColumn("shrunk", shrunk).where("lift < 1 and shrunk > 1").withColumn("gap", F.round((F.col("shrunk") - 1) * (1 - F.col("lift")), 9))
    return out.orderBy(F.desc("gap"), "tag").limit(limit).select("tag", "support", "co", "lift", "gap")

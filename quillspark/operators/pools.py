"""Candidate pools from several sources, and the learned-factor signal."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators import corpus as op
from quillspark.operators import ranking as rk
from quillspark.operators import related as rel


def _ranked(df: DataFrame, value: str, limit: int) -> DataFrame:
    """The best `limit` of (id, value), with their places as pos."""
    best = df.orderBy(F.desc(value), "id").limit(limit)
    return best.withColumn("pos", F.row_number().over(W.orderBy(F.desc(value), "id"))).select("id", "pos")


def tag_pool(work_tags: DataFrame, seeds: DataFrame, limit: int, works: DataFrame | None = None) -> DataFrame:
    """(id, pos): works by how many of the seeds' tags they carry. works, here and below: what there is to choose from, if not all."""
    held = op.carried(work_tags).join(F.broadcast(rk.seed_tags(work_tags, seeds)), "tag").groupBy(F.col("work_id").alias("id")).agg(F.count("*").alias("shared"))
    return _ranked(_known(_unseeded(held, seeds), works), "shared", limit)


def _unseeded(df: DataFrame, seeds: DataFrame) -> DataFrame:
    return df.join(F.broadcast(seeds.select(F.col("seed").alias("id"))), "id", "left_anti")


def _known(df: DataFrame, works: DataFrame | None) -> DataFrame:
    return df if works is None else df.join(op.apart(works.select("id")), "id", "left_semi")


def weighted_pool(work_tags: DataFrame, near: DataFrame, seeds: DataFrame, limit: int, works: DataFrame | None = None) -> DataFrame:
    """(id, pos): works by the summed weight of a bounded list of tags (tag, w)."""
    held = op.carried(work_tags).join(F.broadcast(near), "tag").groupBy(F.col("work_id").alias("id")).agg(F.round(F.sum("w"), 9).alias("w"))
    return _ranked(_known(_unseeded(held, seeds), works), "w", limit)


def near_tags(work_tags: DataFrame, tag_vectors: DataFrame, seeds: DataFrame, k: int = 32, least: float = 0.25) -> DataFrame:
    """(tag, w): the k tags of highest cosine, `least` or more, with the mean of the seeds' centroids, the seeds' tags left out."""
    vectors = tag_vectors.where(F.exists("v", lambda x: x != 0))
    rows = work_tags.join(F.broadcast(seeds.select(F.col("seed").alias("work_id"))), "work_id", "left_semi")
    centre = rk.mean_vectors(rows, vectors).select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("x"))
    centre = centre.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda z: z["x"]).alias("qv"))
    sim = vectors.join(F.broadcast(rk.seed_tags(work_tags, seeds)), "tag", "left_anti").join(F.broadcast(centre)).select("tag", F.round(rk.fn.cosine(F.col("v"), F.col("qv")), 9).alias("w"))
    return sim.where(F.col("w") >= least).orderBy(F.desc("w"), "tag").limit(k)


def walk_pool(work_tags: DataFrame, mass: DataFrame, seeds: DataFrame, limit: int, top: int = 24, works: DataFrame | None = None) -> DataFrame:
    """(id, pos): works by how many of the `top` tags of largest walk mass (tag, mass) they carry."""
    return weighted_pool(work_tags, mass.orderBy(F.desc(F.round("mass", 9)), "tag").limit(top).select("tag", F.lit(1.0).alias("w")), seeds, limit, works)


def candidate_pool(works: DataFrame, work_tags: DataFrame, interactions: DataFrame, tag_vectors: DataFrame | None, seeds: DataFrame, limit: int, gate: int = 1, top: int = 50, mass: DataFrame | None = None, votes: DataFrame | None = None, fixed: bool = False) -> DataFrame:
    """(id, source, place) of at most `limit` works: by the seeds' tags, by their readers, near in vectors, by a walk.

    Readers and vectors each reserve an eighth of the places (rounded up, none of two places), which the tags leave free. Each
    source beside the tags is asked for as many works as there are places left before it; what nothing fills goes to the
    tags' next works. fixed: they are asked for the reserve alone, as candidate_pool's SQL does. votes: of the seeds' readers,
    if they are at hand.
    """
    reserve = min(-(-limit // 8), limit - 1) if limit > 2 else 0
    budget = min(limit, max(1, limit - reserve * (1 + (tag_vectors is not None))))
    tags, room = tag_pool(work_tags, seeds, limit, works), limit - budget if fixed else limit
    votes = (rk.collab_votes(interactions, seeds, gate, top) if votes is None else votes).withColumn("vote", F.round("vote", 9))
    others = [_ranked(_known(votes, works), "vote", room)]
    if tag_vectors is not None:
        others.append(weighted_pool(work_tags, near_tags(work_tags, tag_vectors, seeds), seeds, room, works))
    if mass is not None:
        others.append(walk_pool(work_tags, mass, seeds, room, works=works))
    if fixed:
        return op.admit([tags.where(F.col("pos") <= budget), *others, tags.where(F.col("pos") > budget)], limit).select("id", "source", "place")
    every = reduce(DataFrame.union, (x.select(F.lit(1).alias("request"), "id", "pos", F.lit(k).alias("source")) for k, x in enumerate([tags, *others])))
    kind = works.schema["id"].dataType.simpleString()

    tail = len(others) + 1

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["source", "pos"])
        lists = [g["id"][g["source"] == k].tolist() for k in range(tail)]
        out: dict = {}
        for k, ids in enumerate([lists[0][:budget], *lists[1:], lists[0][budget:]]):
            for i in ids if k == tail else ids[: limit - len(out)]:
                if len(out) < limit:
                    out.setdefault(i, k)
        return pd.DataFrame({"id": list(out), "source": list(out.values()), "place": range(1, len(out) + 1)})

    return every.groupBy("request").applyInPandas(run, f"id {kind}, source int, place int")


def latent(factors: DataFrame, seeds: DataFrame, most: int = 8) -> DataFrame:
    """(id, value): largest cosine of a work's learned factors with those of the first `most` seeds, zero at least.

    Without factors of a work, or of any seed, there is no opinion. factors: (id, features).
    """
    own = factors.join(F.broadcast(seeds.orderBy("seed").limit(most).select(F.col("seed").alias("id"))), "id").select(F.col("features").alias("sf"))
    met = factors.join(F.broadcast(own))
    return met.groupBy("id").agg(F.greatest(F.lit(0.0), F.max(rk.fn.cosine(F.col("features"), F.col("sf")))).alias("value"))


def author_popularity(works: DataFrame, limit: int) -> DataFrame:
    """(author, works, hits): authors by all their hits, the baseline for related authors."""
    return works.groupBy(F.lower("authors").alias("author")).agg(F.count("*").alias("works"), F.sum("hits").alias("hits")).orderBy(F.desc("hits"), "author").limit(limit)


#: Related entities by kind and algorithm; an unknown pair is an error.
RELATED = {
    ("work", "adamic"): lambda r, seeds, limit=20, **k: rel.adamic(r.interactions, seeds, limit),
    ("author", "popular"): lambda r, limit=20, **k: author_popularity(r.works, limit),
    ("tag", "near"): lambda r, seed, **k: rk.tag_neighbours(r.works, r.work_tags, seed),
}


def related(roles, kind: str, algorithm: str, **options) -> DataFrame:
    if (kind, algorithm) not in RELATED:
        raise ValueError(f"no algorithm {algorithm!r} for {kind!r}; there are {sorted(RELATED)}")
    return RELATED[kind, algorithm](roles, **options)


def checked_tune(changes: dict[str, float]) -> dict[str, float]:
    """Changed weights; names without a signal, negative and non-finite weights are errors, as is a sum of zero."""
    unknown = sorted(set(changes) - set(rk.DEFAULT_TUNE))
    if unknown:
        raise ValueError(f"no such signals: {unknown}")
    if any(not 0 <= w < float("inf") for w in changes.values()):
        raise ValueError("weights are finite and not negative")
    out = rk.DEFAULT_TUNE | changes
    if not sum(out.values()):
        raise ValueError("all weights are zero")
    return out

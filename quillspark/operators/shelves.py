"""Shelves and harvests per universe, authors by tag profile, themes, divided families, fingerprints of vector tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.functions import scoring as fn
from quillspark.operators import corpus as op
from quillspark.operators import ranking as rk
from quillspark.operators import upkeep as up
from quillspark.sources.staging import staged

# -- a reader's shelf --------------------------------------------------------------------------------------------------


def taste_scores(read: DataFrame, work_tags: DataFrame) -> DataFrame:
    """(work_id, s) of the works that carry a tag of a reader's works (work_id): summed taste over 1+ln(number of the work's tags)."""
    c = op.carried(work_tags)
    n = c.groupBy("work_id").agg(F.count("*").alias("n"))
    s = op.apart(op.apart(c).join(up.shelf_taste(read, work_tags), "tag").groupBy("work_id").agg(F.sum("taste").alias("taste"))).join(op.apart(n), "work_id")
    return s.select("work_id", F.round(F.col("taste") / (1 + F.log("n")), 9).alias("s"))


def universe_works(work_tags: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(universe, work_id): works by the catalogue's names (name, works), whatever the case or kind of the tag."""
    names = catalogue.select(F.lower("name").alias("universe")).distinct()
    return op.apart(op.carried(work_tags).select(F.lower("tag").alias("universe"), "work_id").distinct()).join(names, "universe")


def ranked_universes(members: DataFrame, scores: DataFrame, catalogue: DataFrame, read: DataFrame, limit: int, least: int = 3, top: int = 25, least_catalogue: int = 0) -> DataFrame:
    """(universe, n, score, catalogue, bookmarked): universes by the mean score of their best `top` works."""
    best = W.partitionBy("universe").orderBy(F.desc("s"), "work_id")
    score = op.apart(members).join(op.apart(scores), "work_id").withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= top).groupBy("universe").agg(F.round(F.avg("s"), 9).alias("score"))
    size = members.groupBy("universe").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    known = catalogue.groupBy(F.lower("name").alias("universe")).agg(F.max("works").alias("catalogue")).where(F.col("catalogue") >= least_catalogue)
    mine = op.apart(members).join(op.apart(read.distinct()), "work_id").groupBy("universe").agg(F.count("*").alias("m"))
    all_ = score.join(size, "universe").join(known, "universe").join(mine, "universe", "left")
    out = all_.select("universe", "n", "score", "catalogue", F.coalesce("m", F.lit(0)).alias("bookmarked"))
    return out.orderBy(F.desc("score"), F.desc("n"), "universe").limit(limit)


def without_variants(ranked: DataFrame, members: DataFrame, least: float = 0.5, ratio: float = 0.25) -> list[str]:
    """Names of a ranked list (a few hundred, a top-k's rows) without spellings of one universe: the larger one keeps the place."""
    rows = ranked.orderBy(F.desc("score"), F.desc("n"), "universe").select("universe", "n").collect()
    size = {r["universe"]: r["n"] for r in rows}
    mine = members.join(F.broadcast(ranked.select("universe")), "universe", "left_semi").select("work_id", F.col("universe").alias("tag"))
    same = {frozenset((r["small"], r["large"])) for r in op.overlaps(mine, least, ratio).collect()}
    kept: list[str] = []
    for name in size:
        twin = next((i for i, k in enumerate(kept) if frozenset((name, k)) in same), None)
        if twin is None:
            kept.append(name)
        elif size[name] > size[kept[twin]]:
            kept[twin] = name
    return kept


def shelf_pool(members: DataFrame, scores: DataFrame, works: DataFrame, universes: DataFrame, pool: int) -> DataFrame:
    """(universe, id, s, place): each universe's `pool` works by taste, lifted a little by kudos."""
    lifted = F.round(F.col("s") * (1 + 0.25 * F.log1p(F.coalesce("kudos", F.lit(0))) / 8), 9)
    rows = members.join(F.broadcast(universes), "universe", "left_semi").join(op.apart(scores), "work_id").join(op.apart(works.select(F.col("id").alias("work_id"), "kudos")), "work_id")
    place = F.row_number().over(W.partitionBy("universe").orderBy(F.desc("lifted"), "work_id"))
    return rows.withColumn("lifted", lifted).withColumn("place", place).where(F.col("place") <= pool).select("universe", F.col("work_id").alias("id"), "s", "place")


def build_shelf(works: DataFrame, work_tags: DataFrame, catalogue: DataFrame, read: DataFrame, universes: int = 100, per: int = 200, least: int = 3, lam: float = 0.75, least_catalogue: int = 0) -> DataFrame:
    """(universe, rank, id, score, place): a reader's universes, best first and one spelling each, each filled with varied works.

    read: (work_id). Of 3 * universes ranked ones the spellings go; each is filled from twice as many works as it holds, scores
    scaled to that of the pool's first work.
    """
    spark = works.sparkSession
    # read by three jobs each
    scores, members = staged(taste_scores(read, work_tags), "scores"), staged(universe_works(work_tags, catalogue), "members")
    ranked = staged(ranked_universes(members, scores, catalogue, read, 3 * universes, least, least_catalogue=least_catalogue), "universes")
    names = without_variants(ranked, members)[:universes]
    chosen = spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "universe string, rank long")
    pool = shelf_pool(members, scores, works, chosen, 2 * per).join(F.broadcast(chosen), "universe")
    pool = pool.withColumn("top", F.max(F.when(F.col("place") == 1, F.col("s"))).over(W.partitionBy("universe")))
    # at most 2 * per works a universe
    lists = rk.tag_sets(work_tags).select(F.col("work_id").alias("id"), "tags").join(F.broadcast(pool), "id").select(F.col("rank").alias("request"), "id", F.col("s").alias("score"), "tags", F.lit("").alias("grp"), "top")
    out = rk.mmr(lists, per, lam, 0, 0.9)
    return out.join(F.broadcast(chosen), out["request"] == chosen["rank"]).select("universe", "rank", "id", "score", "place")


def harvest_fill(found: DataFrame, held: DataFrame, quotas: DataFrame, lam: float = 0.75, pool: int = 400) -> DataFrame:
    """(universe, id, place): of what a crawl found (universe, id, score, tags) and isn't held (id), varied works up to the quota.

    quotas: (universe, quota). Works held don't take a place; each universe chooses among its `pool` best.
    """
    best = F.row_number().over(W.partitionBy("universe").orderBy(F.desc("score"), "id"))
    live = found.join(held.select("id").distinct(), "id", "left_anti").join(quotas.where("quota > 0"), "universe").withColumn("rn", best).where(F.col("rn") <= pool)
    keyed = live.withColumn("request", F.xxhash64("universe"))
    most = quotas.agg(F.max("quota")).first()[0] or 0
    picked = rk.mmr(keyed.select("request", "id", "score", "tags", F.lit("").alias("grp")), int(most), lam)
    return picked.join(keyed.select("request", "id", "universe", "quota"), ["request", "id"]).where(F.col("place") <= F.col("quota")).select("universe", "id", "place")


# -- authors by tag profile --------------------------------------------------------------------------------------------


def authors_like(works: DataFrame, work_tags: DataFrame, author: str, limit: int = 10, least: int = 3, most_tags: int = 24, most_works: int = 5000) -> DataFrame:
    """(author, works, score): authors whose works carry the rarest tags of an author's works, by cosine over these tags.

    Tags on fewer than `least` works relate nobody; of the others the `most_tags` rarest count, weighted by count and ln(N/df); the
    other side is binary, so many works don't help. The most liked `most_works` works with such a tag are looked at.
    """
    c = op.carried(work_tags)
    seeds = works.where(F.lower("authors").contains(author.strip().lower())).select(F.col("id").alias("work_id"))
    total = works.agg(F.count("*").alias("total"))
    counted = c.join(seeds, "work_id").groupBy("tag").agg(F.count("*").alias("c"))
    weighed = counted.join(op.doc_frequency(work_tags).where(F.col("df") >= least), "tag").join(F.broadcast(total))
    profile = weighed.select("tag", "df", (F.col("c") * fn.idf(F.col("df"), F.col("total"))).alias("w")).where("w > 0").orderBy("df", "tag").limit(most_tags)
    norm = profile.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    hits = c.join(F.broadcast(profile), "tag")
    names = works.select(F.col("id").alias("work_id"), "authors", "kudos").join(hits.select("work_id").distinct(), "work_id", "left_semi")
    near = names.orderBy(F.desc("kudos"), "work_id").limit(most_works).select("work_id", F.explode(fn.authors_of(F.col("authors"))).alias("author"))
    near = near.withColumn("key", fn.author_key(F.col("author"))).where((F.col("key") != "") & (F.col("key") != fn.author_key(F.lit(author))))
    per_tag = near.join(hits, "work_id").groupBy("key", "tag").agg(F.first("w").alias("w"))
    per = per_tag.groupBy("key").agg(F.sum("w").alias("dot"), F.count("*").alias("shared"))
    named = near.groupBy("key").agg(F.min("author").alias("author"), F.countDistinct("work_id").alias("works"))
    out = per.join(named, "key").join(F.broadcast(norm)).select("author", "works", F.round(F.col("dot") / (F.col("norm") * F.sqrt("shared")), 9).alias("score"))
    return out.orderBy(F.desc("score"), F.desc("works"), "author").limit(limit)


# -- themes ------------------------------------------------------------------------------------------------------------


def _under_top(families: DataFrame, members: DataFrame) -> DataFrame:
    """(id, work): members of a top family or of one of its children, each once."""
    top = families.select(F.col("id").alias("family"), F.coalesce("parent", "id").alias("top"))
    return members.join(F.broadcast(top), "family").select(F.col("top").alias("id"), "work").distinct()


def themes(families: DataFrame, members: DataFrame, works: DataFrame, samples: int = 3) -> DataFrame:
    """(id, label, size, sample array<(work, title)>) of the top families (id, parent, label, size), with their first known works."""
    rows = _under_top(families, members).join(works.select(F.col("id").alias("work"), "title"), "work")
    first = rows.withColumn("rn", F.row_number().over(W.partitionBy("id").orderBy("work"))).where(F.col("rn") <= samples)
    shown = first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("work", "title"))).alias("sample"))
    return families.where("parent is null").join(shown, "id", "left").select("id", "label", "size", F.coalesce("sample", F.array().cast("array<struct<work:bigint,title:string>>")).alias("sample"))


def theme_works(families: DataFrame, members: DataFrame, works: DataFrame, family: int, limit: int) -> DataFrame:
    """(work, title): the first works of a family and its children."""
    mine = families.where((F.col("id") == family) | (F.col("parent") == family)).select(F.col("id").alias("family"))
    rows = members.join(F.broadcast(mine), "family", "left_semi").select("work").distinct()
    return rows.join(works.select(F.col("id").alias("work"), "title"), "work").orderBy("work").limit(limit)


def divide(members: DataFrame, k: int, rounds: int = 40, seed: int = 7) -> DataFrame:
    """(family, sub, id, support, dist): each family of (family, id, support, v) cut in k parts of like size.

    Points choose in order of how clearly they belong somewhere; a part is full at half as much again as its share. Parts of one
    member are left out. Families of tags are meant: their members number a vocabulary's, not a corpus's.
    """

    def cut(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id").reset_index(drop=True)
        x = np.stack([np.asarray(v, float) for v in g["v"]])
        n, parts = len(x), min(k, len(x))
        rng = np.random.default_rng([seed, int(g["family"][0]) & 0xFFFFFFFF])
        centre = [x[rng.integers(n)]]
        while len(centre) < parts:  # each next start is drawn by its squared distance from those before
            d = np.min([((x - c) ** 2).sum(axis=1) for c in centre], axis=0)
            centre.append(x[rng.choice(n, p=d / d.sum()) if d.sum() > 0 else rng.integers(n)])
        centre, full, part = np.stack(centre), max(2, -(-3 * n // (2 * parts))), np.full(n, -1)
        for _ in range(rounds):
            d = np.stack([((x - c) ** 2).sum(axis=1) for c in centre], axis=1)
            near = np.argsort(d, axis=1, kind="stable")
            gap = d[np.arange(n), near[:, 1]] - d[np.arange(n), near[:, 0]] if parts > 1 else np.zeros(n)
            load, new = [0] * parts, part.copy()
            for i in np.argsort(-gap, kind="stable"):
                new[i] = next((p for p in near[i] if load[p] < full), near[i][0])
                load[new[i]] += 1
            centre = np.stack([x[new == p].mean(axis=0) if load[p] else centre[p] for p in range(parts)])
            if (new == part).all():
                break
            part = new
        out = pd.DataFrame({"family": g["family"], "sub": part, "id": g["id"], "support": g["support"], "dist": np.sqrt(((x - centre[part]) ** 2).sum(axis=1))})
        return out[out.groupby("sub")["id"].transform("size") > 1]

    return members.select("family", "id", "support", "v").groupBy("family").applyInPandas(cut, "family long, sub long, id long, support long, dist double")


# -- fingerprints of vector tables -------------------------------------------------------------------------------------


def _norm(v):
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def fingerprint(vectors: DataFrame) -> DataFrame:
    """One row (rows, width, mean_norm, centroid) of a table (id, v), over all its rows; an empty table gives none."""
    totals = vectors.agg(F.count("*").alias("rows"), F.max(F.size("v")).cast("long").alias("width"), F.avg(_norm(F.col("v"))).alias("mean_norm")).where("rows > 0")
    means = vectors.select(F.posexplode("v").alias("p", "x")).groupBy("p").agg((F.sum(F.col("x").cast("double"))).alias("x"))
    return totals.join(F.broadcast(means.agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("m")))).select("rows", "width", "mean_norm", F.transform("m", lambda s: s["x"] / F.col("rows")).alias("centroid"))


def drift_between(old: DataFrame, new: DataFrame, sample: int = 64, floor: float = 0.98) -> DataFrame:
    """One row: how far a rebuilt table of vectors (id, v) has moved from the one before, and in a word.

    Centroids and mean norms are of all rows; single vectors are compared over the `sample` smallest ids of each that both have, those
    without direction only counted (empty). width changed, nothing shared, moved, rescaled (norms by a tenth or more), reproduced.
    """
    before, after = (fingerprint(t).select(*(F.col(c).alias(f"{c}_{n}") for c in ("rows", "width", "mean_norm", "centroid"))) for t, n in ((old, "before"), (new, "after")))
    pick = lambda t, name: t.orderBy("id").limit(sample).select("id", F.col("v").alias(name))
    both = pick(old, "v").join(pick(new, "w"), "id").withColumn("some", (_norm(F.col("v")) > 0) & (_norm(F.col("w")) > 0))
    cosine = F.when(F.col("some") & (F.size("v") == F.size("w")), fn.cosine(F.col("v"), F.col("w")))
    moved = both.agg(F.count_if("some").alias("sampled"), F.count_if(~F.col("some")).alias("empty"), F.avg(cosine).alias("sample_cosine"))
    row = before.join(F.broadcast(after)).join(F.broadcast(moved))
    same = F.col("width_before") == F.col("width_after")
    ratio = F.when(F.col("mean_norm_before") > 0, F.col("mean_norm_after") / F.col("mean_norm_before")).otherwise(0.0)
    verdict = F.when(~same, "width changed").when(F.col("sampled") == 0, "nothing shared").when(F.col("sample_cosine") < floor, "moved")
    verdict = verdict.when((F.col("norm_ratio") < 0.9) | (F.col("norm_ratio") > 1.1), "rescaled").otherwise("reproduced")
    out = row.withColumn("centroid_cosine", F.when(same, fn.cosine(F.col("centroid_before"), F.col("centroid_after")))).withColumn("norm_ratio", ratio)
    return out.select("rows_before", "rows_after", "centroid_cosine", "norm_ratio", "sample_cosine", "sampled", "empty", verdict.alias("verdict"))

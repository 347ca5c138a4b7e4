"""Related entities over readers, tags and vectors, and walks on the tag graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import scoring as fn
from quillspark.operators import corpus as op
from quillspark.sources.staging import staged


def best_of(df: DataFrame, key: str, other: str, score: str, n: int) -> DataFrame:
    """A key's n best partners; scores compare after rounding, then names."""
    df = df.withColumn(score, F.round(score, 9))
    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), other))).where(F.col("rank") <= n)


def adamic(interactions: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """Shared readers, each counting the less the more it has read: 1/(1+log10(1+degree))."""
    r = op.reads(interactions)
    degree = r.groupBy("user_id").agg(F.count("*").alias("deg"))
    near = r.join(F.broadcast(seeds.select(F.col("seed").alias("work_id"))), "work_id").select("user_id", F.col("work_id").alias("seed")).join(degree, "user_id")
    s = r.join(near, "user_id").where("work_id <> seed").groupBy("seed", F.col("work_id").alias("other")).agg(F.sum(1 / (1 + F.log10(1 + F.col("deg")))).alias("score"))
    return best_of(s, "seed", "other", "score", n)


def popular_within_tags(works: DataFrame, work_tags: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    c = op.carried(work_tags)
    s = c.join(F.broadcast(seeds.select(F.col("seed").alias("work_id"))), "work_id").select(F.col("work_id").alias("seed"), "tag")
    x = c.join(F.broadcast(s), "tag").where("work_id <> seed").select("seed", F.col("work_id").alias("other")).distinct()
    x = x.join(works.select(F.col("id").alias("other"), "kudos"), "other")
    return x.withColumn("rank", F.row_number().over(W.partitionBy("seed").orderBy(F.desc("kudos"), "other"))).where(F.col("rank") <= n).select("seed", "other", "kudos", "rank")


def tag_jaccard(work_tags: DataFrame, seed: DataFrame, n: int) -> DataFrame:
    df = op.doc_frequency(work_tags)
    e = op.symmetric(op.tag_pairs(work_tags)).join(F.broadcast(seed.select(F.col("tag").alias("src"))), "src")
    e = e.join(df.select(F.col("tag").alias("src"), F.col("df").alias("a")), "src").join(df.select(F.col("tag").alias("dst"), F.col("df").alias("b")), "dst")
    return best_of(e.withColumn("jac", F.col("co") / (F.col("a") + F.col("b") - F.col("co"))), "src", "dst", "jac", n).select("src", "dst", "jac", "rank")


def author_tags(works: DataFrame, work_tags: DataFrame) -> DataFrame:
    return op.carried(work_tags).join(works.select(F.col("id").alias("work_id"), F.col("authors").alias("author")), "work_id").where("tag <> author")


def authors_by_tags(works: DataFrame, work_tags: DataFrame, n: int) -> DataFrame:
    """Sum of log10(1+N/df) over tags that both authors use."""
    t = author_tags(works, work_tags).select("author", "tag").distinct()
    total = works.agg(F.count("*").alias("n"))
    w = op.doc_frequency(work_tags).join(F.broadcast(total)).select("tag", F.log10(1 + F.col("n") / F.col("df")).alias("w"))
    p = t.join(w, "tag").join(t.select("tag", F.col("author").alias("other")), "tag").where("author <> other").groupBy("author", "other").agg(F.sum("w").alias("score"))
    return best_of(p, "author", "other", "score", n)


def authors_by_readers(works: DataFrame, interactions: DataFrame, n: int) -> DataFrame:
    a = op.reads(interactions).join(works.select(F.col("id").alias("work_id"), F.col("authors").alias("author")), "work_id").select("author", "user_id").distinct()
    p = a.join(a.select("user_id", F.col("author").alias("other")), "user_id").where("author <> other").groupBy("author", "other").agg(F.count("*").alias("shared"))
    return p.withColumn("rank", F.row_number().over(W.partitionBy("author").orderBy(F.desc("shared"), "other"))).where(F.col("rank") <= n)


def similar_authors(works: DataFrame, work_tags: DataFrame, n: int, least_df: int = 3) -> DataFrame:
    """Cosine of authors' tag counts weighted by ln(N/df)."""
    total = works.agg(F.count("*").alias("n"))
    df = op.doc_frequency(work_tags).where(F.col("df") >= least_df).join(F.broadcast(total)).where("df < n").select("tag", F.log(F.col("n") / F.col("df")).alias("idf"))
    w = author_tags(works, work_tags).join(df, "tag").groupBy("author", "tag").agg((F.count("*") * F.first("idf")).alias("w"))
    norm = w.groupBy("author").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    p = w.join(w.select("tag", F.col("author").alias("other"), F.col("w").alias("v")), "tag").where("author <> other").groupBy("author", "other").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    p = p.join(norm, "author").join(norm.select(F.col("author").alias("other"), F.col("norm").alias("onorm")), "other")
    return best_of(p.withColumn("sim", F.col("dot") / (F.col("norm") * F.col("onorm"))), "author", "other", "sim", n).select("author", "other", "sim", "rank")


def bridges(works: DataFrame, work_tags: DataFrame, kind: str, seed: DataFrame, n: int) -> DataFrame:
    """Works that share a universe with the seed and stand in others too."""
    f = work_tags.where(F.col("tag_type") == kind).select("work_id", "tag").distinct()
    own = f.join(F.broadcast(seed.select(F.col("seed").alias("work_id"))), "work_id", "left_semi").select("tag", F.lit(1).alias("hit"))
    b = f.join(F.broadcast(seed.select(F.col("seed").alias("work_id"))), "work_id", "left_anti").join(F.broadcast(own), "tag", "left")
    b = b.groupBy(F.col("work_id").alias("id")).agg(F.count("hit").alias("shared"), F.count_if(F.col("hit").isNull()).alias("others")).where("shared >= 1 and others >= 1")
    return b.join(works.select("id", "kudos"), "id").orderBy(F.desc("others"), F.desc("kudos"), "id").limit(n)


def pair_similarity(pairs: DataFrame, works: DataFrame, work_tags: DataFrame, centroids: DataFrame) -> DataFrame:
    """Mean of the smoothed-IDF Jaccard similarity and the cosine of centroids, over those that both works have."""
    total = works.agg(F.count("*").alias("n"))
    w = op.doc_frequency(work_tags).join(F.broadcast(total)).select("tag", F.log1p(F.col("n") / (1 + F.col("df"))).alias("w"))
    t = op.carried(work_tags).join(w, "tag")
    mass = t.groupBy("work_id").agg(F.sum("w").alias("m"))
    side = lambda c: t.select(F.col("work_id").alias(c), "tag", F.col("w").alias(f"w_{c}"))
    both = pairs.join(side("x"), "x").join(side("y").drop("w_y"), ["y", "tag"]).groupBy("x", "y").agg(F.sum("w_x").alias("b"))
    out = pairs.join(both, ["x", "y"], "left")
    for c in ("x", "y"):
        out = out.join(mass.select(F.col("work_id").alias(c), F.col("m").alias(f"m_{c}")), c).join(centroids.select(F.col("work_id").alias(c), F.col("v").alias(f"v_{c}")), c)
    b = F.coalesce("b", F.lit(0.0))
    return out.select("x", "y", ((b / (F.col("m_x") + F.col("m_y") - b) + F.greatest(F.lit(0.0), fn.cosine(F.col("v_x"), F.col("v_y")))) / 2).alias("sim"))


def personal_walk(edges: DataFrame, seed: DataFrame, damping: float = 0.85, rounds: int = 20, least: float = 1e-5, eps: float = 1e-6, shown: float = 1e-4) -> DataFrame:
    """(tag, mass): random walk with restart over (src, dst, co), steps by share of co, seeds left out of the result.

    Tags of less mass than `least` neither push nor stay, what they and tags without neighbours hold returns to the seeds;
    tags of less than `shown` aren't listed. Rounds end early once the mass moves by less than eps in all. A round is a
    join and a sum, written to the shared folder.
    """
    out = edges.groupBy("src").agg(F.sum("co").alias("total"))
    step = staged(edges.join(out, "src").select("src", "dst", (F.col("co") / F.col("total")).alias("p")), "walk")
    n = seed.agg(F.count("*").alias("n"))
    home = staged(seed.select("tag").distinct().join(F.broadcast(n)).select("tag", (1.0 / F.col("n")).alias("home")), "home")
    mass = home.select("tag", F.col("home").alias("mass"))
    for _ in range(rounds):
        flow = step.join(mass.withColumnRenamed("tag", "src"), "src").groupBy(F.col("dst").alias("tag")).agg(F.sum(F.col("p") * F.col("mass")).alias("flow"))
        kept = flow.agg(F.coalesce(F.sum("flow"), F.lit(0.0)).alias("flown"))
        new = flow.join(home.join(F.broadcast(kept)), "tag", "full_outer")
        back = (1 - damping * F.coalesce("flown", F.lit(1.0))) * F.coalesce("home", F.lit(0.0))
        new = staged(new.select("tag", (damping * F.coalesce("flow", F.lit(0.0)) + back).alias("mass")).where(F.col("mass") >= least), "walk")
        moved = new.join(mass.withColumnRenamed("mass", "was"), "tag", "full_outer").agg(F.sum(F.abs(F.coalesce("mass", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
        mass = new
        if (moved or 0.0) < eps:
            break
    return mass.join(home, "tag", "left_anti").where(F.col("mass") >= shown)


def reading_path(vectors: DataFrame, seed: int, steps: int, pull: float = 0.5) -> DataFrame:
    """Greedy path from a seed: next is what is near the last step and not near the seed. `steps` bounded top-1 queries."""
    spark = vectors.sparkSession
    at = lambda i: vectors.where(F.col("id") == i).first()["v"]
    origin = at(seed)
    path, here = [(0, seed, 1.0)], origin
    for k in range(1, steps + 1):
        worth = fn.cosine(F.col("v"), F.array(*map(F.lit, here))) - pull * fn.cosine(F.col("v"), F.array(*map(F.lit, origin)))
        best = vectors.where(~F.col("id").isin([p[1] for p in path])).select("id", "v", F.round(worth, 9).alias("worth")).orderBy(F.desc("worth"), "id").first()
        if best is None:
            break
        path.append((k, best["id"], best["worth"]))
        here = best["v"]
    return spark.createDataFrame(path, "step int, id long, worth double")


def center_similarity(vectors: DataFrame, least: float) -> DataFrame:
    """Cosine with the mean vector, and whether that is at `least`."""
    m = vectors.select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("m"))
    return vectors.join(F.broadcast(m)).select("id", fn.cosine(F.col("v"), F.col("m")).alias("sim")).withColumn("central", F.col("sim") >= least)

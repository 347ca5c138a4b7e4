"""Facts about edges, names, addresses, works and verdicts: small relations and expressions that other operators build on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import stats
from quillspark.operators import corpus as op

#: Letters of ratings and what is stored for them.
RATINGS = {"G": "General Audiences", "T": "Teen And Up Audiences", "M": "Mature", "E": "Explicit"}
#: Kinds of explanation that duel.
DUELS = ("tags", "readers")

# -- edges ----------------------------------------------------------------------------------------------------------


def upserted_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(a, b, weight) with a < b; of rows of one pair that of the highest key among new wins, then any of new over stored."""
    pair = lambda df, late: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.struct(F.lit(late).alias("late"), "key", "weight").alias("w"))
    both = pair(stored, 0).union(pair(new, 1))
    return both.groupBy("a", "b").agg(F.max("w").alias("w")).select("a", "b", "w.weight")


def graph_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fault, n): what breaks a symmetric graph. nodes: (id); edges: (src, dst, weight). All zero where it is sound."""
    known = nodes.select("id").distinct()
    missing = lambda c: edges.join(known, F.col(c) == F.col("id"), "left_anti")
    sides = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    per = sides.agg(F.count_if(F.col("src") < F.col("dst")).alias("up"), F.count_if(F.col("src") > F.col("dst")).alias("down"), F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    count = lambda df, name: df.agg(F.lit(name).alias("fault"), F.count(F.lit(1)).alias("n"))
    parts = [
        count(missing("src").union(missing("dst")), "unknown node"),
        count(edges.where("src = dst"), "loop"),
        count(edges.where("weight is null or weight <= 0"), "no weight"),
        count(per.where("a < b and (up = 0 or down = 0)"), "one way"),
        count(per.where("a < b and (up > 1 or down > 1)"), "repeated"),
        count(per.where("a < b and up > 0 and down > 0 and lo <> hi"), "unequal weights"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def trimmed(mass: DataFrame, n: int, key: str = "id", value: str = "mass") -> DataFrame:
    """The n rows of most mass, ties to the smaller key."""
    return mass.orderBy(F.desc(value), key).limit(n)


# -- sets of tags ---------------------------------------------------------------------------------------------------


def shared_weight(x: DataFrame, y: DataFrame, by: list[str]) -> DataFrame:
    """(by.., shared, weight): number of tags on both sides and the sum of the smaller weight of each. x, y: (by.., tag, weight)."""
    both = x.join(y.withColumnRenamed("weight", "other"), [*by, "tag"])
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("shared"), F.sum(F.least("weight", "other")).alias("weight"))


def name_jaccard(x: Column, y: Column) -> Column:
    """Jaccard similarity of two arrays of names without case; 0 where either is empty or null."""
    low = lambda c: F.array_distinct(F.transform(c, F.lower))
    both, all_ = F.size(F.array_intersect(low(x), low(y))), F.size(F.array_union(low(x), low(y)))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both / all_).otherwise(0.0)


def shared_names(before: Column, after: Column, most: int = 3) -> Column:
    """The first names of after that before has too; after's order (rarest first) is kept."""
    return F.slice(F.filter(after, lambda t: F.array_contains(before, t) & (t != "")), 1, most)


def rarest_first(work_tags: DataFrame) -> DataFrame:
    """(work_id, tags): a work's tags from the rarest to the most common, ties by name."""
    t = op.carried(work_tags).join(op.doc_frequency(work_tags).select("tag", "df"), "tag")
    return t.groupBy("work_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "tag"))), lambda s: s["tag"]).alias("tags"))


# -- addresses and codes ----------------------------------------------------------------------------------------------


def listing_kind(url: Column) -> Column:
    """What a listing's address lists: tag, search, user-works, user-bookmarks, collection, series, or nothing (empty)."""
    path = F.coalesce(F.trim(F.regexp_extract(url, r"^(?:[a-z]+://[^/?#]*)?/*([^?#]*)", 1)), F.lit(""))
    seg = F.split(F.regexp_replace(path, "/+$", ""), "/")
    first, last, n = seg[0], F.element_at(seg, -1), F.size(seg)
    asked = F.regexp_extract(url, r"^[^?#]*\?([^#]+)", 1) != ""
    return (
        F.when((first == "tags") & ((n == 2) | ((n >= 3) & (last == "works"))), "tag")
        .when((first == "works") & asked, "search")
        .when((first == "users") & (last == "works"), "user-works")
        .when((first == "users") & (last == "bookmarks"), "user-bookmarks")
        .when((first == "collections") & (last == "works"), "collection")
        .when((first == "series") & (n == 2) & (last != "new"), "series")
        .otherwise("")
    )


def seed_of(s: Column) -> Column:
    """(kind, id) of "kind:id"; null unless the whole of it is so."""
    t = F.trim(s)
    kind, number = F.regexp_extract(t, r"^([^:]+):([+-]?\d+)$", 1), F.regexp_extract(t, r"^([^:]+):([+-]?\d+)$", 2).try_cast("long")
    return F.when(number.isNotNull(), F.struct(kind.alias("kind"), number.alias("id")))


def stored_rating(v: Column) -> Column:
    """The stored name of a rating's letter, whatever its case; anything else stays and matches what it matches."""
    out = v
    for letter, name in RATINGS.items():
        out = F.when(F.upper(F.trim(v)) == letter, name).otherwise(out)
    return out


# -- works --------------------------------------------------------------------------------------------------------------


def lookup(works: DataFrame, work_tags: DataFrame, ids: DataFrame) -> DataFrame:
    """All columns of the works asked for, each once, with their tags as an array. ids: (id)."""
    wanted = works.join(ids.select("id").distinct(), "id", "left_semi")
    tags = work_tags.join(wanted.select(F.col("id").alias("work_id")), "work_id", "left_semi").groupBy(F.col("work_id").alias("id"))
    return wanted.join(tags.agg(F.sort_array(F.collect_set("tag")).alias("tags")), "id", "left")


def stats_of(works: DataFrame) -> DataFrame:
    """(id, stats): a work's numbers by name. An unknown count of bookmarks is told by has_bookmarks, a language by its own name."""
    number = lambda *names: [x for c in names for x in (F.lit(c), F.col(c).cast("double"))]
    have = F.col("bookmarks").isNotNull()
    stats_ = F.map_concat(
        F.create_map(*number("kudos", "hits", "word_count", "complete"), F.lit("has_bookmarks"), have.cast("double")),
        F.when(have, F.create_map(*number("bookmarks"))).otherwise(F.create_map().cast("map<string,double>")),
        F.when(F.col("update_date").isNotNull(), F.create_map(F.lit("update_date"), F.unix_date("update_date").cast("double"))).otherwise(F.create_map().cast("map<string,double>")),
        F.when(F.col("language") != "", F.create_map(F.concat(F.lit("language_"), "language"), F.lit(1.0))).otherwise(F.create_map().cast("map<string,double>")),
    )
    return works.select("id", stats_.alias("stats"))


def known_lengths(works: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, word_count) of the works asked for whose length is known."""
    return works.where("word_count > 0").join(ids.select("id").distinct(), "id", "left_semi").select("id", "word_count")


# -- vectors --------------------------------------------------------------------------------------------------------------


def vector_norms(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, v, norm) of the vectors of the right width; the others belong to another build."""
    return vectors.where(F.size("v") == dim).select("id", "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("norm"))


def vector_counts(vectors: DataFrame, dim: int) -> DataFrame:
    """One row: vectors read, and skipped for their width."""
    right = F.coalesce(F.size("v") == dim, F.lit(False))
    return vectors.agg(F.count_if(right).alias("read"), F.count_if(~right).alias("skipped"))


def coherence(members: DataFrame, k: int) -> DataFrame:
    """One row (own, other): mean cosine of the members with their family's centroid and with the next family's. members: (id, family, v)."""
    at = members.where("family >= 0").select("id", "family", F.posexplode("v").alias("p", "x"))
    centre = at.groupBy("family", "p").agg(F.avg(F.col("x").cast("double")).alias("c"))
    size = centre.groupBy("family").agg(F.sqrt(F.sum(F.col("c") ** 2)).alias("nc"))
    centre = centre.join(size, "family")
    both = at.withColumn("to", F.explode(F.array(F.struct(F.col("family").alias("f"), F.lit(True).alias("own")), F.struct(((F.col("family") + 1) % k).alias("f"), F.lit(False).alias("own")))))
    met = both.select("id", "p", "x", "to.*").join(centre.withColumnRenamed("family", "f"), ["f", "p"], "left")
    cos = met.groupBy("id", "own").agg(F.sum(F.col("x") * F.col("c")).alias("dot"), F.sqrt(F.sum(F.col("x").cast("double") ** 2)).alias("n"), F.max("nc").alias("nc"))
    value = F.when((F.col("n") > 0) & (F.col("nc") > 0), F.col("dot") / (F.col("n") * F.col("nc"))).otherwise(0.0)
    return cos.agg(F.avg(F.when(F.col("own"), value)).alias("own"), F.avg(F.when(~F.col("own"), value)).alias("other"))


def observed_rmse(seen: DataFrame, users: DataFrame, works: DataFrame, alpha: float) -> DataFrame:
    """One row: confidence-weighted error of the cells that were observed. seen: (user_id, work_id); users, works: (id, v)."""
    x, y = users.select(F.col("id").alias("user_id"), F.col("v").alias("x")), works.select(F.col("id").alias("work_id"), F.col("v").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    return seen.join(x, "user_id").join(y, "work_id").agg(F.coalesce(F.sqrt(F.avg(((1 + alpha) * (1 - dot)) ** 2)), F.lit(0.0)).alias("rmse"))


# -- verdicts -------------------------------------------------------------------------------------------------------------


def explanation_standings(duels: DataFrame) -> DataFrame:
    """One row for each kind of explanation, also without any duel: (kind, wins, losses, ties, judged, p, verdict). duels: (winner)."""

    @F.pandas_udf("double")
    def p(w: pd.Series, l: pd.Series) -> pd.Series:  # noqa: E741
        return pd.Series([stats.sign_test(int(a), int(b)) for a, b in zip(w, l)])

    @F.pandas_udf("string")
    def verdict(w: pd.Series, l: pd.Series) -> pd.Series:  # noqa: E741
        return pd.Series([stats.vote_verdict(int(a), int(b)) for a, b in zip(w, l)])

    n = duels.agg(*(F.count_if(F.col("winner") == c).alias(c) for c in (*DUELS, "neither")))
    side = lambda a, b: F.struct(F.lit(a).alias("kind"), F.col(a).alias("wins"), F.col(b).alias("losses"), F.col("neither").alias("ties"))
    rows = n.select(F.explode(F.array(side(*DUELS), side(*DUELS[::-1]))).alias("r")).select("r.*")
    return rows.withColumn("judged", F.col("wins") + F.col("losses") + F.col("ties")).withColumn("p", p("wins", "losses")).withColumn("verdict", verdict("wins", "losses"))


def predictors(findings: DataFrame, most: int = 8) -> DataFrame:
    """(side, tag, mean_dev, signed, n, place): tags whose weight points the way their works deviate, and those that point the other.

    findings: (tag, dev, weight), a row for each held-out work that carries the tag.
    """
    per = findings.groupBy("tag").agg(F.avg("dev").alias("mean_dev"), F.avg("weight").alias("signed"), F.count(F.lit(1)).alias("n"))
    pull = F.col("mean_dev") * F.col("signed")
    per = per.withColumn("side", F.when(pull > 0, "predictor").when(pull < 0, "anti-predictor")).where("side is not null")
    place = F.row_number().over(W.partitionBy("side").orderBy(F.round(F.abs(pull), 9).desc(), "tag"))
    return per.withColumn("place", place).where(F.col("place") <= most)

"""Profiles, agreement, arena pairing, catalogue upkeep and quality assurance of stored records."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quillspark.functions import scoring as fn
from quillspark.functions.hashing import fnv1a64
from quillspark.operators import corpus as op


@pandas_udf(StringType())
def fnv_id(names: pd.Series) -> pd.Series:
    """FNV-1a 64 of a name as 16 hex digits; null stays null."""
    return pd.Series([None if s is None else f"{h:016x}" for s, h in zip(names, fnv1a64(names).tolist())], dtype=object)


def arm_of(owner: Column, arms: list[str]) -> Column:
    """Stable assignment of an owner to an arm by FNV-1a."""

    @pandas_udf(StringType())
    def pick(o: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else arms[h % len(arms)] for x, h in zip(o, fnv1a64(o).tolist())], dtype=object)

    return pick(owner.cast("string"))


def upsert_works(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace stored ones of their id, but an unknown bookmark count keeps the stored one."""
    cols = [c for c in stored.columns if c != "id"]
    both = stored.select("id", F.struct(*cols).alias("o")).join(new.select("id", F.struct(*cols).alias("n")), "id", "full_outer")
    val = lambda c: F.when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(F.coalesce(f"n.{c}", f"o.{c}") if c == "bookmarks" else F.col(f"n.{c}"))
    return both.select("id", *(val(c).alias(c) for c in cols))


def field_drift(old: DataFrame, new: DataFrame, exact: list[str], tolerated: dict[str, float]) -> DataFrame:
    """(field, kind, works): how stored and fresh records of an id differ: same, drift within a tolerated share, mismatch."""
    cols = [*exact, *tolerated]
    both = old.select("id", *(F.col(c).alias(f"o_{c}") for c in cols)).join(new.select("id", *(F.col(c).alias(f"n_{c}") for c in cols)), "id")

    def kind(c: str) -> Column:
        o, n = F.col(f"o_{c}"), F.col(f"n_{c}")
        close = F.abs(n - o) <= tolerated[c] * F.greatest(F.abs(o), F.lit(1)) if c in tolerated else F.lit(False)
        return F.struct(F.lit(c).alias("field"), F.when(o.eqNullSafe(n), "same").when(close, "drift").otherwise("mismatch").alias("kind"))

    return both.select(F.explode(F.array(*map(kind, cols))).alias("x")).groupBy("x.field", "x.kind").agg(F.count("*").alias("works"))


def profile_from_works(liked: DataFrame, works: DataFrame, work_tags: DataFrame) -> DataFrame:
    """(tag, weight): engagement weights of the liked works (id) summed per tag, the largest scaled to one."""
    w = works.join(liked, "id", "left_semi").select(F.col("id").alias("work_id"), fn.decade_weight(F.col("kudos")).alias("w"))
    s = op.carried(work_tags).join(w, "work_id").groupBy("tag").agg(F.sum("w").alias("s"))
    return s.join(F.broadcast(s.agg(F.max("s").alias("m")))).select("tag", (F.col("s") / F.col("m")).alias("weight"))


def profile_from_ratings(rated: DataFrame, work_tags: DataFrame) -> DataFrame:
    """(tag, weight) from (id, rating 1..10, confidence): sum of (rating-5.5)*confidence over (sum of confidence + 3), scaled."""
    r = rated.withColumnRenamed("id", "work_id")
    s = op.carried(work_tags).join(r, "work_id").groupBy("tag").agg((F.sum((F.col("rating") - 5.5) * F.col("confidence")) / (F.sum("confidence") + 3)).alias("s"))
    return s.join(F.broadcast(s.agg(F.max(F.abs("s")).alias("m")))).select("tag", F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(0.0).alias("weight"))


def profile_score(work_tags: DataFrame, profile: DataFrame) -> DataFrame:
    """Sum of a work's tag weights over the root of its number of tags."""
    per = op.carried(work_tags).join(profile, "tag", "left").groupBy(F.col("work_id").alias("id")).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("s"), F.count("*").alias("n"))
    return per.select("id", (F.col("s") / F.sqrt("n")).alias("score"))


def shelf_taste(read: DataFrame, work_tags: DataFrame) -> DataFrame:
    """(tag, taste) of one reader's works (work_id): count over 1+ln(1+df), the largest scaled to one."""
    t = op.apart(op.carried(work_tags)).join(op.apart(read), "work_id").groupBy("tag").agg(F.count("*").alias("c")).join(op.doc_frequency(work_tags), "tag").withColumn("t", F.col("c") / (1 + F.log1p("df")))
    return t.join(F.broadcast(t.agg(F.max("t").alias("m")))).select("tag", (F.col("t") / F.col("m")).alias("taste"))


def shelf_scores(read: DataFrame, works: DataFrame, work_tags: DataFrame, limit: int) -> DataFrame:
    """Unread works by taste over 1+ln(number of tags), lifted a little by kudos."""
    c = op.carried(work_tags)
    s = c.join(shelf_taste(read, work_tags), "tag", "left").groupBy(F.col("work_id").alias("id")).agg((F.coalesce(F.sum("taste"), F.lit(0.0)) / (1 + F.log(F.count("*")))).alias("s"))
    s = s.join(read.select(F.col("work_id").alias("id")), "id", "left_anti").join(works.select("id", "kudos"), "id")
    score = F.round(F.col("s") * (1 + 0.25 * F.log1p("kudos") / 8), 9)
    return s.withColumn("score", score).orderBy(F.desc("score"), "id").limit(limit).select("id", "score")


def agreement(vectors: DataFrame, least_shared: int = 5, literal: bool = False, block: int = 1000, digits: int | None = None) -> DataFrame:
    """(x, y, shared, agree): cosine of owners' tag vectors (owner, tag, weight) that share `least_shared` tags or more.

    literal: norms run over the shared tags only. Owners are dealt to parts, each packed into one row of arrays; each two parts
    meet once, `block` by `block` owners as matrix products, and hand on what a product gives before the next. A part is copied
    once for every part: there are 24 at most, or as many as hold 16 blocks. digits: agree is rounded as by F.round.
    """
    v = vectors.where("owner is not null and tag is not null")
    owners = v.select("owner").distinct().count()
    parts = max(1, min(24, -(-owners // block)), -(-owners // (16 * block)))
    kind, tag = (v.schema[c].dataType.simpleString() for c in ("owner", "tag"))
    rows = v.select(F.pmod(F.xxhash64("owner"), F.lit(parts)).cast("int").alias("part"), "owner", "tag", F.col("weight").cast("double").alias("weight"))

    def coded(c: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
        c = c.combine_chunks().dictionary_encode()
        order = pc.sort_indices(c.dictionary)
        return c.dictionary.take(order), np.argsort(order.to_numpy())[c.indices.to_numpy()]

    def pack(t: pa.Table) -> pa.Table:
        (o, at), (g, col), w = coded(t["owner"]), coded(t["tag"]), t["weight"].combine_chunks()
        known, w = w.is_valid().to_numpy(zero_copy_only=False), w.fill_null(0.0).to_numpy()
        order = np.lexsort((w, known, col, at))
        raw = {c: pa.array([x[order].astype(k).tobytes()], pa.binary()) for c, x, k in (("at", at, np.int32), ("col", col, np.int32), ("w", w, np.float64), ("known", known, np.uint8))}
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.table({"part": t["part"][:1], "owners": one(o), "tags": one(g), **raw})

    packed = rows.groupBy("part").applyInArrow(pack, f"part int, owners array<{kind}>, tags array<{tag}>, at binary, col binary, w binary, known binary")
    held = ("owners", "tags", "at", "col", "w", "known")
    dealt = packed.select("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("c"), *held)
    dealt = dealt.select(F.least("part", "c").alias("i"), F.greatest("part", "c").alias("j"), (F.col("part") <= F.col("c")).alias("first"), *held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        own = t["i"][0].as_py() == t["j"][0].as_py()
        at = {t["first"][k].as_py(): k for k in range(t.num_rows)}
        if not own and len(at) < 2:  # a part without owners
            return
        of = t["owners"].type.value_type
        a = _Part(t.slice(at[True], 1), block)
        b = a if own else _Part(t.slice(at[False], 1), block)
        for m in range(a.blocks):
            for n in range(m if own else 0, b.blocks):
                x, y, shared, agree, known = _meet(a.block(m), b.block(n), own and m == n, least_shared, literal)
                agree = agree if digits is None else _rounded(agree, digits)
                x, y = a.owners[x], b.owners[y]
                turned = x > y
                cols = [pa.array(np.where(turned, y, x), of), pa.array(np.where(turned, x, y), of), pa.array(shared), pa.array(agree, mask=None if known is None else ~known)]
                yield pa.RecordBatch.from_arrays(cols, ["x", "y", "shared", "agree"])

    return dealt.repartition(parts * (parts + 1) // 2, "i", "j").groupBy("i", "j").applyInArrow(meet, f"x {kind}, y {kind}, shared long, agree double")


class _Part:
    """A part's owners, in blocks: (owner places, places of rows, tags, weights, known, sums of squares)."""

    def __init__(self, t: pa.Table, size: int):
        self.owners = t["owners"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.tags = t["tags"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        raw = (np.frombuffer(t[c][0].as_py(), k) for c, k in (("at", np.int32), ("col", np.int32), ("w", np.float64), ("known", np.uint8)))
        self.at, self.col, self.w, self.known = raw
        self.size, self.blocks = size, -(-len(self.owners) // size)

    def block(self, k: int) -> tuple:
        low, high = k * self.size, min(len(self.owners), (k + 1) * self.size)
        s = slice(*np.searchsorted(self.at, (low, high)))
        at, w = self.at[s] - low, self.w[s]
        with np.errstate(all="ignore"):
            return low, high - low, at, self.tags[self.col[s]], w, self.known[s], np.bincount(at, w * w, high - low)


def _meet(a: tuple, b: tuple, same: bool, least_shared: int, literal: bool) -> tuple:
    """Places of owners that share enough, the tags they share, their agreement, and where it is known (None: everywhere)."""
    both = np.intersect1d(a[3], b[3])

    def matrices(low, n, at, tag, w, known, squares):
        """By owner and shared tag: weights, squares, rows, rows with a weight; the latter once if all have one."""
        col = np.minimum(np.searchsorted(both, tag), max(0, len(both) - 1))
        held = both[col] == tag if len(both) else np.zeros(len(tag), bool)
        flat, w, known = at[held].astype(np.int64) * len(both) + col[held], w[held], known[held]
        dense = lambda x: np.bincount(flat, x, n * len(both)).reshape(n, len(both))
        some = dense(None).astype(float)
        return dense(w), dense(w * w), some, some if known.all() else dense(known)

    with np.errstate(all="ignore"):
        (wa, qa, na, ka), (wb, qb, nb, kb) = matrices(*a), matrices(*b)
        shared = na @ nb.T
        enough = shared >= max(1, least_shared)
        r, c = np.nonzero(np.triu(enough, 1) if same else enough)
        every = len(r) == enough.size
        pick = (lambda m: m.ravel()) if every else (lambda m: m[r, c])
        dot = pick(wa @ wb.T)
        known = None if ka is na and kb is nb else pick(ka @ kb.T) > 0
        sx, sy = (pick(qa @ nb.T), pick(na @ qb.T)) if literal else (a[6][r], b[6][c])
        if not (np.isfinite(qa).all() and np.isfinite(qb).all()):  # a product with what isn't shared is no number either
            for k in np.nonzero(~(np.isfinite(qa).all(1)[r] & np.isfinite(qb).all(1)[c]))[0]:
                s = (na[r[k]] > 0) & (nb[c[k]] > 0)
                dot[k] = wa[r[k]][s] @ wb[c[k]][s]
                if literal:
                    sx[k], sy[k] = qa[r[k]][s] @ nb[c[k]][s], na[r[k]][s] @ qb[c[k]][s]
        norm = np.sqrt(sx * sy)
        some = (norm > 0) | np.isnan(norm)
        agree = np.divide(dot, norm) if some.all() else np.where(some, dot / norm, 0.0)
    return a[0] + r, b[0] + c, pick(shared).astype(np.int64), agree, None if known is None else known | ~some


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As F.round: halves of the shortest decimal go away from zero, so what is near a half is rounded as a decimal."""
    with np.errstate(all="ignore"):
        scaled = x * 10.0**digits
        out = np.rint(scaled)
        near = ~(np.abs(np.abs(scaled - out) - 0.5) > 1e-4) | ~(np.abs(scaled) < 1e9)
        out = out / 10.0**digits + 0.0
    near, large = near & np.isfinite(x), ~(np.abs(x) < 1e15)
    for k in np.nonzero(near & ~large)[0]:
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0
    return np.where(large, x, out)


def influence(agreements: DataFrame, floor: float = 0.05) -> DataFrame:
    return agreements.withColumn("influence", fn.influence(F.col("agree"))).where(F.col("influence") >= floor)


def pair_worth(strategy: str) -> Column:
    """Worth of a pair (ma, pa, ga, fa; mb, pb, gb, fb: rating, deviation, games, affinity) under a strategy, tired by games played.

    random favours what is uncertain on either side and not extreme, maxinfo what tells most, close equal ratings, explore
    what the reader is thought to dislike.
    """
    fatigue = 1 / (1 + F.log1p("ga")) * (1 / (1 + F.log1p("gb")))
    g = lambda phi: 1 / F.sqrt(1 + 3 * (F.col(phi) / 173.7178) ** 2 / F.pi() ** 2)
    e = 1 / (1 + F.exp(-g("pb") * (F.col("ma") - F.col("mb")) / 173.7178))
    boot = F.greatest(F.col("pa") / (350 + F.col("pa")), F.col("pb") / (350 + F.col("pb")))
    centre = 1 - 0.3 * F.least(F.lit(1.0), F.greatest(F.abs(F.col("ma") - 1500), F.abs(F.col("mb") - 1500)) / 800)
    return {"random": boot * centre, "maxinfo": g("pa") * g("pb") * e * (1 - e), "close": 1 - F.abs(F.col("ma") - F.col("mb")) / 600, "explore": 1 - F.col("fa") - F.col("fb")}[strategy] * fatigue


def next_pairs(ratings: DataFrame, judged: DataFrame, strategy: str = "random", top: int = 40, n: int = 10) -> DataFrame:
    """The worthiest pairs among the `top` least certain entities (id, mu, phi, games, affinity), never one judged before (a, b).

    Settled pairs (both certain and far apart) and pairs too far apart are out.
    """
    c = ratings.orderBy(F.desc("phi"), "id").limit(top)
    side = lambda k: c.select(F.col("id").alias(k), F.col("mu").alias("m" + k), F.col("phi").alias("p" + k), F.col("games").alias("g" + k), F.col("affinity").alias("f" + k))
    x, y = side("a"), side("b")
    gap = F.abs(F.col("ma") - F.col("mb"))
    p = x.join(F.broadcast(y), F.col("a") < F.col("b")).withColumn("gap", gap)
    p = p.where(~((F.col("pa") < 80) & (F.col("pb") < 80) & (F.col("gap") > 300)) & (F.col("gap") <= 1000)).join(judged.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    return p.withColumn("worth", F.round(pair_worth(strategy), 9)).orderBy(F.desc("worth"), "a", "b").limit(n).select("a", "b", "worth")


def drop_variants(work_tags: DataFrame, names: DataFrame, least: float = 0.5, ratio: float = 0.25) -> DataFrame:
    """Names that survive when each larger one removes its smaller variants, largest first. The list is bounded by its caller."""
    spark = work_tags.sparkSession
    mine = work_tags.join(F.broadcast(names), "tag", "left_semi")
    size = {r["tag"]: r["df"] for r in op.doc_frequency(mine).collect()}
    near: dict[str, set[str]] = {}
    for r in op.overlaps(mine, least, ratio).collect():
        near.setdefault(r["large"], set()).add(r["small"])
    gone: set[str] = set()
    for t in sorted(size, key=lambda t: (-size[t], t)):
        if t not in gone:
            gone |= near.get(t, set())
    return spark.createDataFrame([(t, size[t]) for t in sorted(size) if t not in gone], "tag string, df long")


def seasons_per_month(seasons: DataFrame, n: int) -> DataFrame:
    w = W.partitionBy("month").orderBy(F.desc(F.round("lift", 9)), "tag")
    return seasons.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("month", "tag", "rank")


def harvest_score(works: DataFrame, work_tags: DataFrame, taste: DataFrame) -> DataFrame:
    """(id, score): logarithmic blend of engagement, lifted by the mean taste of a work's tags, three at most. taste: (tag, weight)."""
    size = taste.agg(F.count("*").alias("size"))
    per = op.carried(work_tags).join(taste, "tag", "left").groupBy(F.col("work_id").alias("id")).agg(F.sum("weight").alias("sum"), F.count("*").alias("tags"))
    quality = F.log10(1 + F.col("kudos")) + 1.5 * F.log10(1 + F.coalesce("bookmarks", F.lit(0))) + 0.25 * F.log10(1 + F.col("hits"))
    affinity = F.least(F.lit(3.0), 3 * F.coalesce("sum", F.lit(0.0)) / F.col("tags") * F.col("size") / 4)
    return works.join(per, "id", "left").join(F.broadcast(size)).select("id", (quality + F.coalesce(affinity, F.lit(0.0))).alias("score"))


def explanation(work_tags: DataFrame, interactions: DataFrame, pairs: DataFrame, least_readers: int = 2) -> DataFrame:
    """Two ways to explain a pair (seed, id): shared tags, and shared readers where there are enough."""
    t = op.carried(work_tags).groupBy("work_id").agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    r = op.reads(interactions)
    shared = pairs.join(r.select(F.col("work_id").alias("seed"), "user_id"), "seed").join(r.select(F.col("work_id").alias("id"), "user_id"), ["id", "user_id"]).groupBy("seed", "id").agg(F.count("*").alias("readers"))
    both = pairs.join(t.select(F.col("work_id").alias("seed"), F.col("tags").alias("a")), "seed").join(t.select(F.col("work_id").alias("id"), F.col("tags").alias("b")), "id").join(shared, ["seed", "id"], "left")
    return both.select("seed", "id", F.array_join(F.array_intersect("a", "b"), ", ").alias("by_tags"), F.when(F.col("readers") >= least_readers, F.format_string("%d readers of both", F.col("readers"))).alias("by_readers"))


def write_listing_csv(works: DataFrame, path: str) -> None:
    """The works listing as CSV; unknown values are the word null."""
    works.write.mode("overwrite").option("header", True).option("nullValue", "null").csv(path)

"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Size: number of [^\\x20\\x09-\\x0D]+ in the text (null: 0). Sources in code-point order, null last, weigh 5, 2, 1, repeating; together
their targets are SHARE times all sizes, none above CAP times its source's size, the excess reshared by weight.

A source's documents fall into blocks by hash of id and text. Its quota is the number of block instances (block, pass) that its
target takes: whole passes over the source, then blocks in permuted order, then one last block of which only those documents
go that still fit. A binary tree over the output shards splits the exact quotas of all sources by multivariate-hypergeometric
draws; each leaf takes the next instances of the source's permutation, so shards are disjoint draws, and what a document is
taken is the shards its block's instances fell to. Documents of a shard are ordered by hash. All draws are seeded: reruns agree.

Every input row gives one output row, also where ids repeat or are null; rows alike in id and text are interchangeable. An empty
table gives none; a source of size 0 has target 0. One row per source goes to the driver. Extra columns are not read. Running
sums over a source's blocks are sums over SLOTS ranges of their hash order, then within a range: no source is one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.llm.shared import stage

WEIGHTS, SHARE, CAP, BLOCK_WORDS, SHARDS = (5, 2, 1), 1.5, 2.0, 1 << 16, 16
#: Words of a shard from which there are more than SHARDS; ranges of the hash order of a source's blocks (a power of two).
SHARD_WORDS, SLOTS = 1 << 25, 4096
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> np.ndarray:
    """Water filling: min(cap*size, level*weight) with the level that uses up the total."""
    size = np.array(sizes, np.float64)
    w = np.array([weights[i % len(weights)] for i in range(len(size))], np.float64)
    total, most, out = share * size.sum(), cap * size, np.zeros(len(size))
    free = np.ones(len(size), bool)
    while free.any():
        level = (total - most[~free].sum()) / w[free].sum()
        over = free & (level * w > most)
        if not over.any():
            out[free] = level * w[free]
            break
        free &= ~over
    out[~free] = most[~free]
    return out


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(source, shard) counts whose rows sum to quotas, by recursive halving of the shards."""
    out = np.zeros((len(quotas), shards), np.int64)

    def halve(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = have
            return
        mid = (lo + hi) // 2
        n = int(have.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, n, method="marginals") if have.sum() else have
        halve(left, lo, mid)
        halve(have - left, mid, hi)

    halve(np.asarray(quotas, np.int64), 0, shards)
    return out


def _upto(rows: DataFrame, turn, value: str, *ties: str) -> DataFrame:
    """rows with upto: the sum of value over the rows of the same k that don't come later in the order of turn and ties."""
    rows = rows.withColumn("turn", turn).withColumn("slot", F.shiftright("turn", 64 - (SLOTS - 1).bit_length()))
    before = F.sum("s").over(W.partitionBy("k").orderBy("slot").rowsBetween(W.unboundedPreceding, -1))
    slots = rows.groupBy("k", "slot").agg(F.sum(value).alias("s")).select("k", "slot", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum(value).over(W.partitionBy("k", "slot").orderBy("turn", *ties).rowsBetween(W.unboundedPreceding, 0))
    return rows.join(slots, ["k", "slot"]).withColumn("upto", F.col("before") + within).drop("before", "slot", "turn")


def _fill(group: pd.DataFrame) -> pd.DataFrame:
    """Documents in hash order as long as they fit; the last gap takes the document that leaves the least."""
    group = group.sort_values(["h", "rid"], kind="stable")
    left, taken = float(group["room"].iloc[0]) if len(group) else 0.0, np.zeros(len(group), bool)
    for i, s in enumerate(group["size"].tolist()):
        if s <= left:
            taken[i] = True
            left -= s
    rest = np.where(taken, np.inf, group["size"].to_numpy(np.float64) - left)
    if len(rest) and rest.min() < left:
        taken[int(rest.argmin())] = True
    return group.loc[taken, ["rid"]]


def _placed(rows: DataFrame, shards: int, seed: int, block_words: int) -> DataFrame:
    """(rid, id, size, source_size, target, shards) of staged rows (rid, id, source, size, h): the shard of each copy taken."""
    spark = rows.sparkSession
    per = rows.groupBy("source").agg(F.sum("size").alias("s")).collect()
    per = sorted(((r["source"], r["s"]) for r in per), key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
    goal = targets([s for _, s in per])
    shards = max(shards, int(-(-goal.sum() // SHARD_WORDS)))
    whole = [int(t // s) if s else 0 for (_, s), t in zip(per, goal)]
    info = [(k, name, s, float(t), q, float(t - q * s) if s else 0.0, max(1, -(-s // block_words))) for k, ((name, s), t, q) in enumerate(zip(per, goal, whole))]
    info = spark.createDataFrame(info, "k int, name string, source_size long, target double, whole int, rest double, blocks long")
    order = lambda *c: F.xxhash64(*c, F.lit(seed))
    rows = rows.join(F.broadcast(info), F.col("source").eqNullSafe(F.col("name"))).withColumn("block", F.pmod(order("h", "k"), F.col("blocks")))
    blocks = rows.groupBy("k", "block").agg(F.sum("size").alias("words"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    blocks = _upto(blocks, order("k", "block"), "words", "block")
    blocks = stage(blocks.select("k", "block", "whole", (F.col("upto") <= F.col("rest")).alias("full"), (F.col("rest") - F.col("upto") + F.col("words")).alias("room")), "blocks")
    edge = blocks.where("not full and room > 0").select("k", "block", "room")
    picked = stage(rows.join(edge, ["k", "block"]).select("k", "block", "rid", "size", "room", "h").groupBy("k", "block").applyInPandas(_fill, "rid long"), "picked")
    passes = F.col("whole") + (F.col("full") | (F.col("room") > 0)).cast("int")
    instances = blocks.where(passes > 0).select("k", "block", "whole", "full", F.explode(F.sequence(F.lit(1), passes)).alias("pass"), F.lit(1).alias("one"))
    quota = {r["k"]: r["count"] for r in instances.groupBy("k").count().collect()}
    leaf = split(np.array([quota.get(k, 0) for k in range(len(per))], np.int64), shards, seed).cumsum(1)
    leaves = spark.createDataFrame([(k, [int(x) for x in leaf[k]]) for k in range(len(per))], "k int, ends array<long>")
    dealt = _upto(instances, order("k", "block", "pass", F.lit("deal")), "one", "block", "pass").join(F.broadcast(leaves), "k")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda u: u < F.col("upto"))))
    # the pass after the whole ones takes all documents of a full block, of the last one those that fit
    dealt = dealt.groupBy("k", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", (F.col("full") | (F.col("pass") <= F.col("whole"))).alias("all")))).alias("at"))
    out = rows.join(dealt, ["k", "block"], "left").join(picked.withColumn("picked", F.lit(True)), "rid", "left")
    mine = F.filter("at", lambda p: p["all"] | F.coalesce(F.col("picked"), F.lit(False)))
    return out.select("rid", "id", "size", "source_size", "target", F.coalesce(F.transform(mine, lambda p: p["shard"]), F.array().cast("array<int>")).alias("shards"))


def _sized(docs: DataFrame, rid, id_col: str, text_col: str, source_col: str) -> DataFrame:
    n = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(rid.alias("rid"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n.alias("size"), F.xxhash64(id_col, text_col).alias("h"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = 17, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, size, source_size, target, taken, shards): shards lists the output shard of each copy the mix takes."""
    rows = stage(_sized(docs, F.monotonically_increasing_id(), id_col, text_col, source_col), "sizes")
    return _placed(rows, shards, seed, block_words).select("id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mixed_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = 17, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixed corpus: all columns of docs, one row per copy taken, with its shard and copy; rows of a shard stand together,
    shuffled by hash. A column of docs called shard or copy gives way to the new one."""
    own = [c for c in docs.columns if c.lower() not in ("shard", "copy", "__rid")]
    kept = stage(docs.select(*own, F.monotonically_increasing_id().alias("__rid")), "mixed")
    rows = stage(_sized(kept, F.col("__rid"), id_col, text_col, source_col), "sizes")
    copies = _placed(rows, shards, seed, block_words).select(F.col("rid").alias("__rid"), F.posexplode("shards").alias("copy", "shard"))
    out = kept.join(copies, "__rid").withColumn("__turn", F.xxhash64(id_col, text_col, "copy", F.lit(seed)))
    return out.repartition("shard").sortWithinPartitions("shard", "__turn").select(*own, "shard", "copy")

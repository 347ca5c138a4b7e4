"""MinHash near-duplicates by min-max hashing: every permutation gives its minimum and its maximum.

Semantics: A-Z lower-cased, words are runs of non-(ASCII)-space characters, a text's set is its distinct k-word shingles
(fewer words: the whole sequence is one; no words: empty). Two sets are linked when 100*|A and B| >= percent*|A or B|.

Nulls: a null text is empty; empty sets and rows with a null id link with nothing and are kept. Rows that repeat an id are
one node. Extra columns are not read. Very long texts are one slice of their own. An empty table gives no rows.

Plan: one Python pass makes set digests, band keys and a 256-bit sketch per text; equal sets collapse into classes by an
aggregate; a bucket (texts with one band key in common) links each member to one pivot, so a bucket of m members makes m
pairs, dealt to tasks in parts; links are confirmed on full sets with array_intersect; buckets whose members are not yet in one component get another
pivot and at last an equi-join on the shingles in which members differ from a pivot, which finds every link across components
without all pairs. Rounds end when no bucket holds two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytekit as bk
from quillspark.llm.shared import components, release, stage

U = np.uint64
#: At a similarity of 0.85 a pair misses every one of 20 bands of four values with probability 4e-7, at 0.80 2.6e-5.
BANDS = 20
#: Sketches of 64 values times four bits: expected distance 256*(1-J)/2; this is over five standard deviations at 0.8.
SKETCH_SLACK = 36
#: Members of a bucket meet its pivot, and pairs of a pivot its set, in parts of about this many, each with a copy of the pivot's row.
PART = 256
_rng = np.random.default_rng(7)
MULTIPLY = _rng.integers(0, 1 << 63, 2 * BANDS, dtype=U) * U(2) + U(1)
XOR = _rng.integers(0, 1 << 64, 2 * BANDS, dtype=U)
MIXERS = _rng.integers(0, 1 << 63, 64, dtype=U) * U(2) + U(1)


def shingles(column, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of texts: first row, row after the last, sorted distinct shingle hashes, bounds of each text."""
    for lo, hi, data, offs, _ in bk.slices(column):
        h, _, _, doc = bk.word_hashes(bk.LOWER[data], offs, ~bk.SPACE)
        n = hi - lo
        at = bk.per_text(doc, n)
        count = np.diff(at)
        acc = np.zeros(max(0, len(h) - k + 1), U)
        for j in range(k):
            acc += h[j : len(h) - k + 1 + j] * MIXERS[j]
        acc = bk.mix(acc)
        inside = np.ones(len(acc), bool)
        inside[doc[: len(acc)] != doc[k - 1 : k - 1 + len(acc)]] = False
        s, owner = acc[inside], doc[: len(acc)][inside]
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            whole = np.array([np.bitwise_xor.reduce(bk.mix(h[at[i] : at[i + 1]] + MIXERS[32 : 32 + count[i]])) for i in short], U)
            s, owner = np.concatenate([s, bk.mix(whole + U(k))]), np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            s, owner = s[order], owner[order]
        at = bk.per_text(owner, n)
        for i in range(n):
            s[at[i] : at[i + 1]].sort()
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
        yield lo, hi, s[first], bk.per_text(owner[first], n)


def _signatures(k: int):
    def run(batches):
        for b in batches:
            for lo, hi, s, at in shingles(b.column(1), k):
                n = np.diff(at)
                full = np.flatnonzero(n)
                m = len(full)
                values = np.empty((m, 4 * BANDS), U)
                digest = np.zeros((2, m), U)
                if m:
                    starts = at[full]
                    for p in range(2 * BANDS):
                        v = (s ^ XOR[p]) * MULTIPLY[p]
                        values[:, 2 * p] = np.minimum.reduceat(v, starts)
                        values[:, 2 * p + 1] = np.maximum.reduceat(v, starts)
                    digest[0] = np.add.reduceat(bk.mix(s ^ U(0x5851F42D4C957F2D)), starts)
                    digest[1] = np.add.reduceat(bk.mix(s + U(0x14057B7EF767814F)), starts)
                keys = np.zeros((m, BANDS), U)
                for j in range(4):
                    keys += values[:, j::4] * MIXERS[8 + j]
                keys = bk.mix(keys + np.arange(BANDS, dtype=U) * U(0x2545F4914F6CDD1D))
                bits = bk.mix(values[:, :64])
                sketch = [np.packbits(((bits >> U(j)) & U(1)).astype(np.uint8), axis=1).view(U).ravel() if m else np.zeros(0, U) for j in range(4)]
                valid = np.zeros(hi - lo, bool)
                valid[full] = True

                def spread(x, valid=valid, full=full):
                    out = np.zeros(len(valid), np.int64)
                    out[full] = x.view(np.int64)
                    return pa.array(out, mask=~valid)

                offsets = np.zeros(hi - lo + 1, np.int32)
                np.cumsum(valid * BANDS, out=offsets[1:])
                yield pa.record_batch(
                    [b.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), spread(digest[0]), spread(digest[1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64))), *(spread(x) for x in sketch)],
                    names=["id", "n", "d0", "d1", "bands", "s0", "s1", "s2", "s3"],
                )

    return run


def _sets(k: int):
    def run(batches):
        for b in batches:
            for lo, hi, s, at in shingles(b.column(1), k):
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(s.view(np.int64)))], names=["id", "h"])

    return run


def _near(percent: int) -> Column:
    """Cheap necessary tests of a pair of class rows x and y: set sizes, and the sketches' distance."""
    apart = sum((F.bit_count(F.col(f"x.s{j}").bitwiseXOR(F.col(f"y.s{j}"))) for j in range(4)), F.lit(0))
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    return (100 * small >= percent * large) & (apart <= round(1.28 * (100 - percent)) + SKETCH_SLACK)


def _parts(m: Column) -> Column:
    return F.ceil(m / PART)


def _copies(one: DataFrame, parts: Column) -> DataFrame:
    """Every row once for each of its parts."""
    return one.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))


def _meet(members: DataFrame, one: DataFrame) -> DataFrame:
    """Members of buckets (key, m, rep, ..) beside their bucket's row in one (key, m, ..): no task gets a whole large bucket."""
    parted = members.withColumn("part", F.pmod(F.xxhash64("rep"), _parts(F.col("m"))))
    return parted.join(_copies(one, _parts(F.col("m"))).drop("m"), ["key", "part"]).drop("part")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked, smaller id first. a may stand in many pairs, which its parts tell."""
    pairs = stage(pairs.groupBy("a", "b").agg(F.max("parts").alias("parts")), "pairs")
    hot = pairs.groupBy(F.col("a").alias("id")).agg(F.max("parts").alias("parts"))
    ha = _copies(sets.join(hot, "id"), F.col("parts")).select(F.col("id").alias("a"), "part", F.col("h").alias("ha"))
    both = F.size(F.array_intersect("ha", "hb"))
    return (
        pairs.select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
        .join(sets.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b")
        .join(ha, ["a", "part"])
        .where(100 * both >= percent * (F.size("ha") + F.size("hb") - both))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )


def _by_differences(now: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links (a, b) of two components in a bucket, from what its texts have unlike a member q of its largest component.

    A text x lacks M(x) of q's shingles and has E(x) that q lacks, which tells whether x is linked with q. Where x or y is not,
    the two are linked only if they share a differing shingle: else they were no more alike than that one and q, which is too
    little already; where both are, q joins them. Where they share none of E, |x ^ y| is at least |E(x)|+|E(y)|+||M(x)|-|M(y)||; where even that is too much, a
    shared M makes no candidate. So an equi-join on differing shingles finds every candidate; full sets confirm.
    """
    size = now.groupBy("key", "root").agg(F.count("*").alias("c"), F.max("m").alias("m"))
    main = size.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("q"), F.max("m").alias("m"))
    member = _meet(now, main).where("rep <> q").groupBy("q", "rep", "root").agg(F.max(_parts(F.col("m"))).alias("parts"))
    member = stage(member, "members")
    hot = member.groupBy(F.col("q").alias("id")).agg(F.max("parts").alias("parts"))
    hq = _copies(sets.join(hot, "id"), F.col("parts")).select(F.col("id").alias("q"), "part", F.col("h").alias("hq"))
    part = member.select("q", "rep", "root", F.pmod(F.xxhash64("rep"), "parts").alias("part"))
    both = part.join(sets.select(F.col("id").alias("rep"), F.col("h").alias("hx")), "rep").join(hq, ["q", "part"])
    unlike = both.select("q", "rep", "root", F.size("hx").alias("n"), F.array_except("hx", "hq").alias("e"), F.array_except("hq", "hx").alias("m"))
    marked = lambda c, own: F.transform(c, lambda s: F.struct(s.alias("s"), F.lit(own).alias("own")))
    each = unlike.select("q", "rep", "root", "n", F.size("e").alias("ne"), F.size("m").alias("nm"), F.explode(F.concat(marked("e", True), marked("m", False))).alias("d")).select("q", "rep", "root", "n", "ne", "nm", "d.s", "d.own")
    each = stage(each, "unlike")
    # q itself, which may have met only other pivots so far
    direct = each.where((F.col("root") != F.col("q")) & (100 * (F.col("n") - F.col("ne")) >= percent * (F.col("n") + F.col("nm"))))
    direct = direct.select(F.least("rep", "q").alias("a"), F.greatest("rep", "q").alias("b")).distinct()
    mixed = each.groupBy("q", "s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("q", "s")
    each = each.join(mixed, ["q", "s"])
    x, y = each.where("root <> q").alias("x"), each.alias("y")
    most = (100 - percent) / (100 + percent) * (F.col("x.n") + F.col("y.n")) + 1e-6
    apart = F.abs(F.col("x.ne") + F.col("x.nm") - F.col("y.ne") - F.col("y.nm"))
    least = F.col("x.ne") + F.col("y.ne") + F.abs(F.col("x.nm") - F.col("y.nm"))
    once = (F.col("y.root") == F.col("y.q")) | (F.col("x.rep") < F.col("y.rep"))
    near = (F.col("x.root") != F.col("y.root")) & once & (apart <= most) & (F.col("x.own") | (least <= most))
    met = x.join(y, (F.col("x.q") == F.col("y.q")) & (F.col("x.s") == F.col("y.s")) & near)
    pairs = met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"), F.lit(1).cast("long").alias("parts"))
    return _confirmed(pairs, sets, percent).union(direct)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", pivots: int = 2) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of docs; component_id is the smallest id reachable by links."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sigs = stage(rows.mapInArrow(_signatures(k), "id long, n long, d0 long, d1 long, bands array<long>, s0 long, s1 long, s2 long, s3 long"), "signatures")
    held = sigs.where("n > 0 and id is not null")
    first = {c: F.min_by(c, "id").alias(c) for c in ("bands", "s0", "s1", "s2", "s3")}
    classes = stage(held.groupBy("d0", "d1", "n").agg(F.min("id").alias("rep"), *first.values()), "classes")
    copies = held.join(classes.select("d0", "d1", "n", "rep"), ["d0", "d1", "n"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    light = classes.select("rep", "n", "s0", "s1", "s2", "s3", F.posexplode("bands").alias("band", "key"))
    shared = light.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    buckets = stage(light.join(shared, "key"), "buckets")
    wanted = buckets.select(F.col("rep").alias("id")).distinct()
    # a repeated id may stand for several sets: an id's sets are united, its rows are one node
    text = rows.join(wanted, "id", "left_semi")
    sets = stage(text.mapInArrow(_sets(k), "id long, h array<long>"), "sets")
    release(spark)
    links = None
    comp = classes.select("rep").limit(0).select(F.col("rep").alias("node"), F.col("rep").alias("root"))
    for turn in range(pivots + 1):
        now = buckets if turn == 0 else buckets.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        if turn:
            open_ = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("m").alias("m")).where("lo < hi").select("key", "m")
            now = stage(_meet(now, open_), "open")
            if now.isEmpty():
                break
        if turn < pivots:
            cols = ["rep", "n", "s0", "s1", "s2", "s3", *(["root"] if turn else [])]
            order = F.col("rep") if turn == 0 else F.xxhash64("rep", F.lit(turn))
            pivot = now.groupBy("key").agg(F.min_by(F.struct(*cols), order).alias("y"), F.max("m").alias("m"))
            met = _meet(now.select("key", "m", "rep", F.struct(*cols).alias("x")), pivot).where((F.col("x.rep") != F.col("y.rep")) & _near(percent))
            pairs = (met.where("x.root <> y.root") if turn else met).select(F.col("y.rep").alias("a"), F.col("x.rep").alias("b"), _parts(F.col("m")).alias("parts"))
            new = _confirmed(pairs, sets, percent)
        else:
            new = _by_differences(now, sets, percent)
        new = stage(new.distinct(), "links")
        release(spark)
        if turn and new.isEmpty():
            continue
        links = new if links is None else links.union(new)
        if turn < pivots:
            comp = components(links)
    comp = components((links.union(copies)) if links is not None else copies)
    out = sigs.select("id", F.col("n").alias("n_shingles")).join(comp.withColumnRenamed("node", "id"), "id", "left")
    root = F.coalesce("root", "id")
    return out.select("id", "n_shingles", root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of smallest id in their near-duplicate group. Rows that repeat an id are one document, and
    stay or go together; rows with a null id stay."""
    gone = near_duplicates(docs, k, percent, id_col, text_col).where("not kept").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")

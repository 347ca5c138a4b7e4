"""Exact substring dedup: every byte covered by a `length`-byte string that also starts earlier goes.

A text is its UTF-8 bytes; strings never cross texts; earlier means a smaller id, or the same id and an earlier start; strings
are judged on the input. A null text is empty. Rows with a null id are neither compared nor changed. Rows that repeat an id
are copies of one document: they have the same positions, so neither is earlier than the other. Extra columns are not read;
an empty table gives no rows; one text of any length is handled as one slice.

How the work is dealt: each string of `length` bytes is keyed by the least hash of its GRAM-byte grams, so equal strings have
equal keys, and consecutive strings with one key form a segment. Keys that occur once are settled by a count, unless the segment
holds its least gram at two places, as periodic text does: only then can it hold equal strings itself. Equal segments
collapse to the earliest; what remains is cut into shards by key (a key with very many different segments over several shards),
and each shard sorts its suffixes by Larsson-Sadakane refinement: a first order on eight bytes, then ranks doubled on the groups
that are still equal. Common prefixes of suffixes that are neighbours in the order follow from the ranks kept of each doubling.
For keys over several shards, each shard's first of every string meets those of the others, and all but the earliest go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytekit as bk
from quillspark.llm.shared import release, stage

GRAM = 32
#: Bytes of segments in a shard, and different segments of one key from which it is dealt over several shards.
SHARD_BYTES, SHARD_SEGMENTS = 1 << 20, 2000
LONGEST = 200
U = np.uint64


def _sliding(x: np.ndarray, span: int, least) -> np.ndarray:
    """Minimum (or maximum) of every span values in a row."""
    width = 1
    while 2 * width <= span:
        x = least(x[:-width], x[width:])
        width *= 2
    return least(x[: len(x) - (span - width)], x[span - width :]) if span > width else x


def segments(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(key, content hash, text index, first string's start in the text, number of strings, whether strings in it may be equal) of a slice's segments."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(U), none.astype(U), none, none, none, none.astype(bool)
    s = bk.prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    gram = bk.mix((s[GRAM:] - s[:-GRAM]) * bk.powers(n + 1)[1][: len(at)])
    span = length - GRAM + 1
    m = _sliding(gram, span, np.minimum)
    edge = np.zeros(span - 1, U)
    least = np.flatnonzero(gram == _sliding(np.concatenate([edge, m, edge]), span, np.maximum))  # least in some string that holds them
    count = np.maximum(np.diff(offs) - length + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offs[:-1], count)
    key = m[start]
    head = np.ones(len(key), bool)
    head[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(key)))
    if (size > LONGEST).any():  # periodic text
        parts = -(-size // LONGEST)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, size = np.repeat(first, parts) + step * LONGEST, np.minimum(np.repeat(size, parts) - step * LONGEST, LONGEST)
    a = start[first]
    lo = np.searchsorted(least, a)
    held = np.searchsorted(least, a + size + span - 1) - lo
    seg = np.repeat(np.arange(len(a)), held)
    met = gram[least[np.arange(len(seg)) - np.repeat(np.cumsum(held) - held, held) + np.repeat(lo, held)]] == key[first][seg]
    inner = np.bincount(seg[met], minlength=len(a)) > 1
    return key[first], bk.range_hash(s, a, a + size + length - 1), doc[first], a - offs[doc[first]], size, inner


def _keys(length):
    def run(batches):
        for b in batches:
            for _, _, data, offs, _ in bk.slices(b.column(1)):
                key, *_, inner = segments(data, offs, length)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(inner)], names=["g", "inner"])

    return run


def _segments(length):
    def run(batches):
        for b in batches:
            for lo, hi, data, offs, _ in bk.slices(b.column(1)):
                key, content, doc, a, size, inner = segments(data, offs, length)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), b.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(a << 8 | size), pa.array(inner)], names=["g", "sh", "id", "at", "inner"])

    return run


def _cut(length):
    """Segment bytes out of (id, text, list of (at, g, shard, hot))."""

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                text = memoryview(b.column(1).slice(i, 1).cast(pa.large_binary())[0].as_buffer())
                wanted = b.column(2).slice(i, 1).flatten()
                at = np.asarray(wanted.field("at"))
                a, size = at >> 8, at & 255
                body = [bytes(text[x : x + k + length - 1]) for x, k in zip(a.tolist(), size.tolist())]
                yield pa.record_batch([wanted.field("shard"), wanted.field("hot"), b.column(0).slice(i, 1).take(pa.array(np.zeros(len(at), np.int64))), pa.array(a), pa.array(body, pa.binary())], names=["shard", "hot", "id", "a", "body"])

    return run


def refined_ranks(text: np.ndarray, left: np.ndarray, depth: int) -> dict[int, np.ndarray]:
    """Ranks of all suffixes by their first 8, 16, ... >= depth/2 bytes; left: bytes to the end of a suffix's segment.

    Bytes beyond a segment's end rank below every byte.
    """
    n = len(text)
    key = np.zeros(n, U)
    for j in range(8):
        col = np.zeros(n, U)
        col[: n - j] = text[j:]
        key = key << U(8) | np.where(left > j, col, U(0))
    order = np.lexsort((np.minimum(left, 8), key))
    k, f = key[order], np.minimum(left, 8)[order]
    new = np.ones(n, bool)
    new[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, h = {8: rank}, 8
    while 2 * h <= depth:
        # only groups that are still equal are sorted again, each within its own place
        single = new & np.append(new[1:], True)
        some = order[~single]
        nxt = np.where(left[some] > h, rank[np.minimum(some + h, n - 1)], -1)
        sub = np.lexsort((nxt, rank[some]))
        some, nxt = some[sub], nxt[sub]
        place = np.flatnonzero(~single)
        order[place] = some
        old = rank[some]
        fresh = np.ones(len(some), bool)
        fresh[1:] = (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1])
        new = new.copy()
        new[place] = fresh
        rank = rank.copy()
        rank[some] = np.maximum.accumulate(np.where(fresh, place, 0))
        h *= 2
        ranks[h] = rank
    return ranks


def _shard(length):
    top = 8
    while 2 * top <= length:
        top *= 2

    def run(key, group):
        col = lambda c: group.column(c).combine_chunks()
        data, offs, _ = bk.utf8(col("body").cast(pa.large_binary()).fill_null(b""))
        sizes = np.diff(offs)
        ids, a, hot = np.asarray(col("id")), np.asarray(col("a")), np.asarray(col("hot"))
        left = np.repeat(offs[1:], sizes) - np.arange(len(data))
        rank = refined_ranks(data, left, length)[top]
        count = sizes - length + 1
        seg = np.repeat(np.arange(len(count)), count)
        inner = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
        w = offs[seg] + inner
        doc, pos = ids[seg], a[seg] + inner
        r1, r2 = rank[w], rank[w + length - top]  # both equal: a common prefix of at least length
        order = np.lexsort((pos, doc, r2, r1))
        same = np.zeros(len(order), bool)
        same[1:] = (r1[order][1:] == r1[order][:-1]) & (r2[order][1:] == r2[order][:-1])
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        gone = order[same & ((doc[order] != doc[head]) | (pos[order] != pos[head]))]  # not what a repeated id has at the first place
        d, p = doc[gone], pos[gone]
        by = np.lexsort((p, d))
        d, p = d[by], p[by]
        start = np.ones(len(d), bool)
        start[1:] = (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1)
        first = np.flatnonzero(start)
        last = np.append(first[1:], len(d)) - 1 if len(d) else first
        heads = order[~same]
        heads = heads[hot[seg[heads]]]
        s = bk.prefix_hash(data)
        d0 = bk.range_hash(s, w[heads], w[heads] + length)
        half = bk.mix(bk.range_hash(s, w[heads], w[heads] + length // 2) * U(3) + bk.range_hash(s, w[heads] + length // 2, w[heads] + length))
        n, m = len(first), len(heads)
        return pa.table(
            {
                "id": np.concatenate([d[first], doc[heads]]), "start": np.concatenate([p[first], pos[heads]]), "end": np.concatenate([p[last] + length, pos[heads] + length]),
                "d0": pa.array(np.concatenate([np.zeros(n, np.int64), d0.view(np.int64)]), mask=np.arange(n + m) < n), "d1": pa.array(np.concatenate([np.zeros(n, np.int64), half.view(np.int64)]), mask=np.arange(n + m) < n),
            }
        ).cast(pa.schema([("id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("d0", pa.int64()), ("d1", pa.int64())]))

    return run


def _apply(batches):
    for b in batches:
        for i in range(len(b)):
            text = memoryview(b.column(1).slice(i, 1).cast(pa.large_binary()).fill_null(b"")[0].as_buffer()) if len(b) else b""
            marks = b.column(2)[i].as_py() or []
            spans: list[list[int]] = []
            for s, e in sorted((min(m["start"], len(text)), min(m["end"], len(text))) for m in marks):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                elif e > s:
                    spans.append([s, e])
            kept, last = [], 0
            for s, e in spans:
                kept.append(text[last:s])
                last = e
            kept.append(text[last:])
            yield pa.record_batch(
                [b.column(0).slice(i, 1), pa.array([len(text)]), pa.array([[{"start": s, "end": e} for s, e in spans]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([b"".join(kept)], pa.binary())],
                names=["id", "n_bytes", "spans", "kept"],
            )


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(id, start, end) spans whose union holds exactly the removed bytes of docs (id, text)."""
    spark = docs.sparkSession
    known = docs.where("id is not null")
    often = stage(known.mapInArrow(_keys(length), "g long, inner boolean").groupBy("g").agg(F.count("*").alias("c"), F.max("inner").alias("inner")).where("c > 1 or inner").select("g"), "keys")
    release(spark)
    cand = stage(known.mapInArrow(_segments(length), "g long, sh long, id long, at long, inner boolean").join(often, "g"), "segments")
    release(spark)
    first = cand.groupBy("g", "sh").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("c"), F.max("inner").alias("inner"))
    first = stage(first.select("g", "sh", "c", "inner", F.col("first.id").alias("id"), F.col("first.at").alias("at")), "first")
    end = (F.shiftright("at", 8) + F.col("at").bitwiseAND(255) + (length - 1)).alias("end")
    copied = cand.join(first.where("c > 1").select("g", "sh", F.col("id").alias("fi"), F.col("at").alias("fa")), ["g", "sh"]).where("id <> fi or at <> fa").select("id", F.shiftright("at", 8).alias("start"), end)
    many = first.groupBy("g").agg(F.count("*").alias("m"), F.max("inner").alias("any")).where("m > 1 or any")
    parts = F.ceil(F.col("m") / SHARD_SEGMENTS)
    todo = first.join(many, "g").select("id", "at", "g", (parts > 1).alias("hot"), F.pmod(F.xxhash64("sh"), parts).alias("part"))
    todo = stage(todo, "todo")
    total = todo.agg(F.sum(F.col("at").bitwiseAND(255) + length)).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    per = todo.groupBy("id").agg(F.collect_list(F.struct("at", "hot", F.pmod(F.xxhash64("g", "part"), F.lit(shards)).alias("shard"))).alias("want"))
    bodies = docs.join(per, "id").mapInArrow(_cut(length), "shard long, hot boolean, id long, a long, body binary")
    found = stage(bodies.groupBy("shard").applyInArrow(_shard(length), "id long, start long, end long, d0 long, d1 long"), "sorted")
    release(spark)
    heads = found.where("d0 is not null")
    best = heads.groupBy("d0", "d1").agg(F.min(F.struct("id", "start")).alias("f"), F.count("*").alias("c")).where("c > 1").select("d0", "d1", "f")
    across = heads.join(best, ["d0", "d1"]).where("id <> f.id or start <> f.start").select("id", "start", "end")
    return copied.union(found.where("d0 is null").select("id", "start", "end")).union(across)


def suffix_dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept) per row: removed byte spans (maximal runs) and the remaining bytes."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = stage(repeated_spans(rows, length).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("marks")), "marks")
    release(docs.sparkSession)
    return rows.join(marks, "id", "left").mapInArrow(_apply, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")

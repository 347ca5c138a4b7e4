"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last 32 bytes has MASK bits clear, at least MIN_CHUNK bytes after the last end, and at
MAX_CHUNK bytes in any case; an insertion therefore moves only the chunks around it. The first chunk of a digest in (id, start)
order stays, every later one is removed. Boundaries depend on content alone, so a passage repeated anywhere has the same
inner chunks.

A null text is empty and has no chunks; rows with a null id are chunked, and sort before all others. Rows that repeat an id
are told apart by the hash of their texts, which is also their order; rows alike in both are one document, and one spans list
holds for each. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytekit as bk
from quillspark.llm.shared import release, stage

MIN_CHUNK, MAX_CHUNK, MASK = 24, 512, np.uint32(((1 << 5) - 1) << 27)
#: What a passage is for the registered query: least bytes of a removed run, and of a stretch in it whose first copies stand in
#: one piece too; a whole document needs neither. Stock lines that many documents share are no passages.
SHORTEST, STRETCH = 100, 80
GEAR = np.random.default_rng(31).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: np.ndarray, offs: np.ndarray, shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of the chunks of a slice of texts."""
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):  # sums of the last 2*width bytes, each shifted by its distance
        shifted = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += shifted
    ends = np.flatnonzero((h & MASK) == 0) + 1
    starts, stops, owner = [], [], []
    bounds = np.searchsorted(ends, offs)
    ends = ends.tolist()
    for i, (lo, hi) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        last = lo
        for e in ends[int(bounds[i]) : int(bounds[i + 1])]:
            if e - lo < 32 or e - last < shortest:  # a hash that saw the previous text is no cut
                continue
            while e - last > longest:
                starts.append(last)
                last += longest
                stops.append(last)
                owner.append(i)
            if e - last >= shortest:
                starts.append(last)
                stops.append(e)
                owner.append(i)
                last = e
        while hi - last > longest:
            starts.append(last)
            last += longest
            stops.append(last)
            owner.append(i)
        if hi > last:
            starts.append(last)
            stops.append(hi)
            owner.append(i)
    return np.array(starts, np.int64), np.array(stops, np.int64), np.array(owner, np.int64)


def _chunks(batches):
    for b in batches:
        for lo, hi, data, offs, _ in bk.slices(b.column(2)):
            start, end, doc = cut_points(data, offs)
            view = memoryview(data)
            digest = b"".join([xxhash.xxh3_128_digest(view[s:e]) for s, e in zip(start.tolist(), end.tolist())])
            d = np.frombuffer(digest, np.int64).reshape(-1, 2)
            own = (b.column(c).slice(lo, hi - lo).take(pa.array(doc)) for c in range(2))
            yield pa.record_batch([*own, pa.array((start - offs[doc]).astype(np.int32)), pa.array((end - start).astype(np.int32)), pa.array(d[:, 0]), pa.array(d[:, 1])], names=["id", "th", "start", "len", "d0", "d1"])


def duplicate_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, start, len, first_id, first_start) of every chunk whose digest occurs earlier; th: hash of the whole text."""
    chunks = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).mapInArrow(_chunks, "id long, th long, start int, len int, d0 long, d1 long")
    chunks = stage(chunks, "chunks")
    first = chunks.groupBy("d0", "d1").agg(F.min(F.struct("id", "th", "start")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = chunks.join(first, ["d0", "d1"]).where(~F.struct("id", "th", "start").eqNullSafe(F.col("first")))
    return met.select("id", "th", "start", "len", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 0, stretch: int = 0) -> DataFrame:
    """Per row of docs: n_bytes, n_chunks removed, bytes removed, removed spans and the ids that keep the removed text.

    Runs of repeated chunks that touch are one span. Every one is removed, unless `shortest` or `stretch` ask for more: then a
    run needs `shortest` bytes, and `stretch` bytes whose first copies touch as well, or to be the whole document.
    """
    found = stage(duplicate_chunks(docs, id_col, text_col), "repeats")
    release(docs.sparkSession)
    each = found.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "len", "first_id", "first_start"))).alias("c"))
    empty = F.array().cast("array<struct<start:int,end:int,n:int,fid:bigint,fend:int,cur:int,best:int>>")

    def fold(acc, c):
        last = F.try_element_at(acc, F.lit(-1))
        touches = (F.size(acc) > 0) & (last["end"] == c["start"])
        goes_on = touches & last["fid"].eqNullSafe(c["first_id"]) & (last["fend"] == c["first_start"])
        cur = F.when(goes_on, last["cur"]).otherwise(0) + c["len"]
        run = F.struct(
            F.when(touches, last["start"]).otherwise(c["start"]).alias("start"), (c["start"] + c["len"]).alias("end"), (F.when(touches, last["n"]).otherwise(0) + 1).alias("n"),
            c["first_id"].alias("fid"), (c["first_start"] + c["len"]).alias("fend"), cur.alias("cur"), F.greatest(F.when(touches, last["best"]).otherwise(0), cur).alias("best"),
        )
        return F.concat(F.when(touches, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc), F.array(run))

    runs = each.select("id", "th", "c", F.aggregate("c", empty, fold).alias("runs"))
    within = lambda c: F.exists("spans", lambda r: (r["start"] <= c["start"]) & (c["start"] < r["end"]))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = base.join(runs, base["id"].eqNullSafe(runs["id"]) & (base["th"] == runs["th"]), "left").drop(runs["id"])
    passage = lambda r: (r["end"] - r["start"] >= shortest) & (r["best"] >= stretch) | (r["start"] == 0) & (r["end"] == F.col("n_bytes"))
    out = out.select("id", "n_bytes", "c", F.filter("runs", passage).alias("spans"))
    out = out.select("id", "n_bytes", "spans", F.array_sort(F.array_distinct(F.transform(F.filter("c", within), lambda c: c["first_id"]))).alias("first_ids"))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, r: a + (r["end"] - r["start"]))
    return out.select(
        "id", "n_bytes", F.coalesce(F.aggregate("spans", F.lit(0), lambda a, r: a + r["n"]), F.lit(0)).cast("long").alias("n_removed_chunks"), F.coalesce(total, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.coalesce(F.transform("spans", lambda r: F.struct(r["start"].cast("long").alias("start"), r["end"].cast("long").alias("end"))), F.array().cast("array<struct<start:long,end:long>>")).alias("spans"), F.coalesce("first_ids", F.array().cast("array<long>")).alias("first_ids"),
    )

"""Language-model scoring with a probabilistic suffix tree over bytes, beside a unigram base over words.

Text: A-Z lower-cased; tokens are the runs of non-(ASCII)-space characters and one end. Rows whose crc32 of the id as text modulo
5 is 1 are held out; all others, null ids included, are learnt from. Base: sum over tokens of
log10((c+0.5)/(N+0.5*(V+1))), c the token's count in training, N all training tokens, V the distinct ones.

The tree's symbols are the text's bytes with runs of space as one blank, and an end. Contexts have up to DEPTH symbols. All
contexts of up to LOW symbols stay; a longer one stays when it was seen LEAST times or more and its next-symbol distribution
diverges from that of its parent (one symbol shorter): the sum of c*ln(share/parent's probability) is at least GAIN nats. With
a context stay its suffixes. A distribution is smoothed with its parent's by the number of symbols seen after it. The score is
the log10 probability of the whole normalised text with its end, each symbol under its longest retained context.

No bound on contexts is relative to the input, so the tree grows with it; it is therefore never in one place. A string of context
and symbol is an integer, the latest symbol of the context first, so that contexts are prefixes; buckets hold all strings
with the same last three symbols. Groups of whole texts count their distinct strings, buckets add the counts in a tree of merges,
build their part of the model, and answer each group's strings with probabilities. Words are counted and answered the same way,
in buckets of their hashes. Strings and counts travel as arrays, not as rows. Only the levels up to LOW are sent to all tasks:
256**(LOW+1) numbers at the very most, a few ten thousand in practice.

A null text is empty and scores its end alone. Every input row gives one output row, also where ids repeat or are null; extra
columns are not read; a text of any length is handled whole. Without any training rows N and V are 0 and symbols are uniform.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytekit as bk
from quillspark.llm.shared import drop, release, stage

DEPTH, LOW, GAIN, LEAST = 6, 2, 8.0, 8
#: Bytes of text in a group, of all text per bucket, groups of a bucket merged or answered at once, most buckets.
GROUP_BYTES, BUCKET_BYTES, FAN, BUCKETS = 12 << 20, 16 << 20, 16, 4096
BLANK, END = 32, 10  # white space other than a blank never stands in normalised text
ALPHABET = 252  # bytes that aren't white space, the blank and the end
COUNT = np.uint64  # of counts in blobs: they follow no order, so differences would only spoil their compression


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each text, runs of space as one blank and none at the ends, then its end: (symbols, offsets)."""
    n = len(offs) - 1
    start, end, doc = bk.words(data, offs, ~bk.SPACE)
    later = np.zeros(len(start), bool)
    later[1:] = doc[1:] == doc[:-1]  # each word but a text's first brings a blank, the space before it
    out_offs = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(doc, end - start + later, n).astype(np.int64) + 1, out=out_offs[1:])
    kept = ~bk.SPACE[data]
    kept[start[later] - 1] = True
    inner = data[kept]
    inner[bk.SPACE[inner]] = BLANK
    out, place = np.full(out_offs[-1], END, np.uint8), np.ones(out_offs[-1], bool)
    place[out_offs[1:] - 1] = False
    out[place] = inner
    return out, out_offs


def coded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string of context and symbol at every place, offsets of the texts). A text's history begins with ends."""
    s, o = symbols(bk.LOWER[data], offs)
    n = len(o) - 1
    place = np.ones(len(s) + DEPTH * n, bool)
    place[(o[:-1, None] + DEPTH * np.arange(n)[:, None] + np.arange(DEPTH)).ravel()] = False
    p = np.full(len(place) + 8, END, np.uint8)
    p[:-8][place] = s
    # eight bytes from every place on as one integer: the lower six are the context of the symbol six places on, oldest symbol lowest
    code = np.ndarray(max(0, len(place) - DEPTH), "<i8", p, strides=(1,))[place[DEPTH:]]
    code &= (1 << 8 * DEPTH) - 1
    code <<= 8
    code |= s
    return code, o


def _packed(x: np.ndarray) -> bytes:
    """An array as bytes: differences of int64 (other kinds as they are), their bytes by place, compressed."""
    y = np.diff(x, prepend=x.dtype.type(0)) if x.dtype == np.int64 else x
    planes = np.ascontiguousarray(np.ascontiguousarray(y).view(np.uint8).reshape(-1, y.itemsize).T)
    return len(x).to_bytes(8, "little") + (pa.Codec("zstd", 1).compress(planes, asbytes=True) if len(x) else b"")


def _unpacked(blob: pa.BinaryScalar, kind=np.int64) -> np.ndarray:
    data = memoryview(blob.as_buffer())
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(pa.py_buffer(data[8:]), n * size), np.uint8)
    y = np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()
    return np.cumsum(y) if kind == np.int64 else y


def _blobs(group: pa.Table, name: str, kind=np.int64) -> list[np.ndarray]:
    return [_unpacked(x, kind) for chunk in group.column(name).chunks for x in chunk]


def _pack(*columns: np.ndarray) -> list[bytes]:
    return [_packed(c) for c in columns]


def _new(sorted_: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    new = np.ones(len(sorted_), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    return new


def _distinct(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(_new(sorted_))


TEXTS = "grp long, texts binary"
CODES = "grp long, bucket long, codes binary, counts binary"
_CODES = pa.schema([("grp", pa.int64()), ("bucket", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary())])


def _by_bucket(code: np.ndarray, times: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """(buckets, codes, times) with the codes of a bucket in one blob, in their order."""
    order, size = np.argsort(to, kind="stable"), np.bincount(to)
    parts = [order[end - n : end] for n, end in zip(size, np.cumsum(size)) if n]
    return np.flatnonzero(size), _pack(*(code[p] for p in parts)), _pack(*(times[p].astype(COUNT) for p in parts))


def _remainder(x: np.ndarray, buckets: int, shift: int = 0) -> np.ndarray:
    out = np.empty(len(x), np.int16)  # BUCKETS fits; numpy sorts it by radix
    for k in range(0, len(x), 1 << 18):
        out[k : k + (1 << 18)] = bk.mix((x[k : k + (1 << 18)] >> shift).view(np.uint64)) % np.uint64(buckets)
    return out


def _string_bucket(code: np.ndarray, buckets: int) -> np.ndarray:
    return _remainder(code, buckets, 32)


def _tallied(code: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct strings in order, how often each was seen in training)."""
    seen = code << 1  # strings have 56 bits
    seen |= held
    seen.sort()
    learnt = (seen & 1) == 0
    seen >>= 1
    first = _distinct(seen)
    return seen[first], np.add.reduceat(learnt, first, dtype=np.int32)


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, of each place the rank of its value)."""
    order = np.argsort(x)
    x = x[order]
    new = _new(x)
    at = np.empty(len(x), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return x[new], at


def _union(kinds: list[np.ndarray]) -> np.ndarray:
    """The distinct values of a group in order, from those of its slices."""
    x = np.concatenate([np.zeros(0, np.int64), *kinds])
    x.sort()
    return x[_new(x)]


def _sums(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The tallies of a group from those of its slices, which are let go."""
    code = _union([x for x, _ in pieces])
    times = np.zeros(len(code), np.int32)
    while pieces:
        x, c = pieces.pop()
        times[np.searchsorted(code, x)] += c
    return code, times


def _slices(batches):
    """(slice of rows, strings, offsets of the texts, words, text of each word) of a group's rows.

    A group's strings never stand in one array: what is kept of a slice is its distinct ones, and of each place which it has.
    """
    for rows in batches:
        for lo, hi, data, offs, _ in bk.slices(rows.column(2)):
            code, o = coded(data, offs)
            h, _, _, doc = bk.word_hashes(bk.LOWER[data], offs, ~bk.SPACE)
            yield rows.slice(lo, hi - lo), code, o, h.view(np.int64), doc


def _groups(batches):
    """The rows of a partition in groups of about GROUP_BYTES, each packed in one row.

    Only the table written from this says which group a text is in: another run may cut otherwise.
    """
    base, done, size, rows = TaskContext.get().partitionId() << 32, 0, 0, []

    def packed():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for r in rows:
                out.write_batch(r)
        return pa.record_batch([pa.array([base + done]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["grp", "texts"])

    for b in batches:
        for lo, hi, data, _, _ in bk.slices(b.column(2)):
            rows.append(b.slice(lo, hi - lo))
            size += len(data)
            if size >= GROUP_BYTES:
                yield packed()
                done, size, rows = done + 1, 0, []
    if rows:
        yield packed()


def _count(buckets: int):
    """A group's distinct strings and (in the second half of the buckets) words, and how often each was seen in training."""

    def run(batches):
        for b in batches:
            for k in range(len(b)):
                strings, words = [], []
                for rows, code, o, word, doc in _slices(pa.ipc.open_stream(b.column(1)[k].as_buffer())):
                    held = np.asarray(rows.column(1))
                    strings.append(_tallied(code, np.repeat(held, np.diff(o))))
                    kind, at = _ranked(word)
                    words.append((kind, np.bincount(at[~held[doc]], minlength=len(kind)).astype(np.int32)))
                code, c = _sums(strings)
                to, codes, times = _by_bucket(code, c, _string_bucket(code, buckets))
                del code
                word, c = _sums(words)
                of, kinds, seen = _by_bucket(word, c, _remainder(word, buckets))
                to = np.concatenate([to, buckets + of])
                yield pa.record_batch([pa.array([b.column(0)[k].as_py()] * len(to), pa.int64()), pa.array(to), pa.array(codes + kinds, pa.binary()), pa.array(times + seen, pa.binary())], names=["grp", "bucket", "codes", "counts"])

    return run


def _merge(key, group):
    """The training counts of a bucket's groups in one."""
    code, times = np.concatenate(_blobs(group, "codes")), np.concatenate(_blobs(group, "counts", COUNT))
    code, times = code[times > 0], times[times > 0]
    order = np.argsort(code, kind="stable")  # runs that are sorted already merge
    code, times = code[order], times[order]
    first = _distinct(code)
    times = np.add.reduceat(times, first) if len(first) else times
    return pa.table([[key[1].as_py()], [key[0].as_py()], _pack(code[first]), _pack(times)], schema=_CODES)


def context(code: np.ndarray, d: int) -> np.ndarray:
    """The context of d symbols of a string."""
    return code >> 8 * (DEPTH + 1 - d)


def shorter(pair: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings without their context's oldest symbol, and their counts added up."""
    up, at = np.unique(parent(pair), return_inverse=True)
    return up, np.bincount(at, c, len(up))


def parent(pair: np.ndarray) -> np.ndarray:
    return pair >> 16 << 8 | pair & 255


def level(pair: np.ndarray, c: np.ndarray, back: np.ndarray, half: float | None = None) -> tuple[np.ndarray, ...]:
    """(contexts, times seen, weight left to the parent, probability of each string, gain over the parent)."""
    ctx, at = np.unique(pair >> 8, return_inverse=True)
    t, k = np.bincount(at, c, len(ctx)), np.bincount(at, minlength=len(ctx)).astype(np.float64)
    k = np.full(len(ctx), half) if half else k
    p = c / (t + k)[at] + (k / (t + k))[at] * back
    return ctx, t, k / (t + k), p, np.bincount(at, c * np.log(c / t[at] / back), len(ctx))


def low_levels(pair: np.ndarray, c: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """(contexts, weight left, strings, probabilities) of the contexts of up to LOW symbols."""
    order = np.argsort(pair, kind="stable")
    counts = [(pair[order], c[order].astype(np.float64))]
    for _ in range(LOW):
        counts.append(shorter(*counts[-1]))
    out = []
    for d, (pair, c) in enumerate(reversed(counts)):
        back = out[-1][3][np.searchsorted(out[-1][2], parent(pair))] if d else np.full(len(pair), 1 / ALPHABET)
        ctx, _, left, p, _ = level(pair, c, back, None if d else ALPHABET / 2)
        out.append((ctx, left, pair, p))
    return out


def deep_levels(code: np.ndarray, times: np.ndarray, low: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """The same for the longer contexts of one bucket, of which those that diverge from their parents stay."""
    counts = [(code, times.astype(np.float64))]
    for _ in range(DEPTH - LOW - 1):
        counts.append(shorter(*counts[-1]))
    found, (pairs, probs) = [], low[-1][2:]
    for pair, c in reversed(counts):
        ctx, t, left, p, gain = level(pair, c, probs[np.searchsorted(pairs, parent(pair))])
        found.append((ctx, left, pair, p, (t >= LEAST) & (gain >= GAIN)))
        pairs, probs = pair, p
    for short, long in zip(found[-2::-1], found[:0:-1]):
        short[4][np.searchsorted(short[0], long[0][long[4]] >> 8)] = True
    out = []
    for ctx, left, pair, p, keep in found:
        some = keep[np.searchsorted(ctx, pair >> 8)]
        out.append((ctx[keep], left[keep], pair[some], p[some]))
    return out


def _find(among: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(among):
        return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
    at = np.minimum(np.searchsorted(among, want), len(among) - 1)
    return at, among[at] == want


def probabilities(levels: list[tuple[np.ndarray, ...]], code: np.ndarray) -> np.ndarray:
    """Of each string's symbol under the longest retained context."""
    p, live = np.full(len(code), 1 / ALPHABET), np.arange(len(code))
    for d, (ctx, left, pair, prob) in enumerate(levels):
        at, hit = _find(ctx, context(code[live], d))
        live, at = live[hit], at[hit]
        own, seen = _find(pair, context(code[live], d) << 8 | code[live] & 255)
        p[live] = np.where(seen, prob[own] if len(prob) else 0.0, left[at] * p[live])
    return p


def _low(batches):
    """Counts of the strings with contexts of LOW symbols, by bucket."""
    for b in batches:
        for code, times in zip(b.column(2), b.column(3)):
            code, times = _unpacked(code), _unpacked(times, COUNT)
            pair, at = np.unique(context(code, LOW) << 8 | code & 255, return_inverse=True)
            yield pa.record_batch([pa.array(pair), pa.array(np.bincount(at, times, len(pair)).astype(np.int64))], names=["pair", "c"])


def _build(low, buckets: int):
    """A bucket's part of the model: arrays of its levels, or its words and their counts."""

    def run(batches):
        for b in batches:
            for k in range(len(b)):
                code, times = _unpacked(b.column(2)[k]), _unpacked(b.column(3)[k], COUNT)
                words = b.column(1)[k].as_py() >= buckets
                found = [(code, times)] if words else deep_levels(code, times, low.value)
                seen, kinds, deepest = (int(times.sum()), len(code), 0) if words else (0, 0, len(found[-1][0]))
                parts = pa.array([_pack(*(c for lv in found for c in lv))], pa.list_(pa.binary()))
                yield pa.record_batch([b.column(1).slice(k, 1), pa.array([seen]), pa.array([kinds]), pa.array([deepest]), parts], names=["bucket", "seen", "kinds", "deepest", "model"])

    return run


def _answer(low, buckets: int):
    """For each string the log10 probability (float), for each word its count (long), in the order they were asked in."""

    def run(key, asked, model):
        words = key[0].as_py() >= buckets
        levels = [] if words else list(low.value)
        for parts in model.column("model") if len(model) else ():
            arrays = [_unpacked(x, (COUNT if words else np.float64) if j % 2 else np.int64) for j, x in enumerate(parts.values)]
            levels += [tuple(arrays[j : j + 4]) for j in range(0, len(arrays), 4)]
        out = []
        for code in _blobs(asked, "codes"):
            if words:
                at, hit = _find(levels[0][0], code) if levels else (None, np.zeros(len(code), bool))
                out.append(np.where(hit, levels[0][1][at], COUNT(0)) if hit.any() else np.zeros(len(code), COUNT))
            else:
                out.append(np.log10(probabilities(levels, code)).astype(np.float32))
        return pa.table([asked.column("grp"), asked.column("bucket"), pa.array(_pack(*out), pa.binary())], names=["grp", "bucket", "found"])

    return run


SCORED = "id long, held_out boolean, n long, n_known long, part double, score double"


def _told(pieces: list[tuple[np.ndarray, np.ndarray]], to, found: np.ndarray):
    """What was found for each place, slice by slice, which are let go; distinct values were asked by bucket, then by code."""
    code = _union([x for x, _ in pieces])
    by_code = np.empty_like(found)
    by_code[np.argsort(to(code), kind="stable")] = found
    for k, (x, at) in enumerate(pieces):
        pieces[k] = None
        yield by_code[np.searchsorted(code, x)][at]


def _score(buckets: int):
    """Per text of a group its score, its words and those seen in training, and the sum of log10(c+0.5) over its words."""
    kinds = {"id": pa.int64(), "held_out": pa.bool_(), "n": pa.int64(), "n_known": pa.int64(), "part": pa.float64(), "score": pa.float64()}

    def run(key, packed, answers):
        strings, words, parts = [], [], []
        for blob in (x for chunk in packed.column("texts").chunks for x in chunk):
            for rows, code, o, word, doc in _slices(pa.ipc.open_stream(blob.as_buffer())):
                strings.append(_ranked(code))
                words.append(_ranked(word))
                parts.append((rows.column(0), rows.column(1), o[:-1], doc.astype(np.int32)))
        if not parts:
            return pa.schema(kinds.items()).empty_table()
        answers = answers.sort_by("bucket")
        near = pc.less(answers.column("bucket"), buckets)
        logs = np.concatenate([np.zeros(0, np.float32), *_blobs(answers.filter(near), "found", np.float32)])
        count = np.concatenate([np.zeros(0, COUNT), *_blobs(answers.filter(pc.invert(near)), "found", COUNT)])
        logs = _told(strings, lambda c: _string_bucket(c, buckets), logs)
        count = _told(words, lambda c: _remainder(c, buckets), count)
        out = []
        for (own, held, begin, doc), p, c in zip(parts, logs, count):
            n = len(own)
            score = np.add.reduceat(p.astype(np.float64), begin)
            new = [np.bincount(doc, minlength=n), np.bincount(doc, c > 0, n).astype(np.int64), np.bincount(doc, np.log10(c + 0.5), n), score]
            out.append(pa.Table.from_arrays([own, held, *map(pa.array, new)], schema=pa.schema(kinds.items())))
        return pa.concat_tables(out)

    return run


def _share(parts: int):
    """Of groups dealt to so many parts, the part of each."""
    return F.pmod(F.xxhash64("grp"), F.lit(parts))


def tree(codes: DataFrame, groups: int, buckets: int) -> tuple[list[tuple[np.ndarray, ...]], DataFrame]:
    """The levels up to LOW, and a table (bucket, seen, kinds, deepest, model) of the retained longer contexts and the words.

    seen, kinds: training words and distinct ones of a bucket; deepest: how many of its contexts have DEPTH symbols.
    """
    spark = codes.sparkSession
    counted, parts = codes, groups
    while True:
        parts = -(-parts // FAN)
        merged = stage(counted.withColumn("part", _share(parts)).groupBy("bucket", "part").applyInArrow(_merge, CODES), "counted")
        if counted is not codes:
            drop(counted)
        counted = merged
        release(spark)
        if parts <= 1:
            break
    pairs = counted.where(F.col("bucket") < buckets).mapInArrow(_low, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    low = low_levels(*(np.asarray(pairs.column(k).combine_chunks()) for k in range(2)))
    model = stage(counted.mapInArrow(_build(spark.sparkContext.broadcast(low), buckets), "bucket long, seen long, kinds long, deepest long, model array<binary>"), "tree")
    drop(counted)
    return low, model


def _answers(codes: DataFrame, model: DataFrame, low: list, parts: int, buckets: int) -> DataFrame:
    """What the model says of each group's strings and words; a bucket's part of the model is copied for every FAN groups."""
    asked = codes.select("bucket", _share(parts).alias("part"), "grp", "codes").groupBy("bucket", "part")
    copies = model.select("bucket", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")).alias("part"), "model").groupBy("bucket", "part")
    said = _answer(codes.sparkSession.sparkContext.broadcast(low), buckets)
    return stage(asked.cogroup(copies).applyInArrow(said, "grp long, bucket long, found binary"), "answers")


def suffix_tree_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size, ends = rows.agg(F.sum(F.octet_length("text") + 1), F.count_if(~F.col("held_out"))).first()
    buckets = min(BUCKETS, max(8, (size or 0) // BUCKET_BYTES))
    texts = stage(rows.mapInArrow(_groups, TEXTS), "texts")
    codes = stage(texts.mapInArrow(_count(buckets), CODES), "codes")
    groups = max(1, texts.count())
    low, model = tree(codes, groups, buckets)
    answers = _answers(codes, model, low, -(-groups // FAN), buckets)
    drop(codes)
    release(spark)
    total = model.agg(F.sum("seen"), F.sum("kinds")).first()
    n_all, kinds = (total[0] or 0) + ends, (total[1] or 0) + (1 if ends else 0)
    drop(model)
    scored = texts.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_score(buckets), SCORED)
    tokens = F.col("n") + 1
    base = F.col("part") + float(np.log10(ends + 0.5)) - tokens * float(np.log10(n_all + 0.5 * (kinds + 1)))
    known = F.col("n_known") + (1 if ends else 0)
    return scored.select("id", "held_out", tokens.alias("n_tokens"), known.alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), "score")

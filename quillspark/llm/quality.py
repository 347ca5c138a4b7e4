"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened for numpy traversal.

Labels come from a table (id, quality 0/1); of repeated labels the mean decides, null labels are left out. Held-out rows
(crc32 of the id as text modulo 5 is 0) are never learnt from. At most TRAIN_ROWS labelled rows are learnt from, those of least
id hash; every document is scored on its whole text. Null and empty texts are scored from zero statistics, rows with a
null id are scored and not held out. Without both classes in training every score is the share of label 1 (0.5 if none).
Every input row gives one output row; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytekit as bk

TRAIN_ROWS, TREES, DEPTH, RATE, BINS, LEAST_LEAF, RIDGE = 20_000, 80, 4, 0.15, 48, 20, 1.0
CUT = 0.3
_CLASSES = [np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b" \t", b"\n\r", b".,;:?'\"", b"!", b"|", b"*", b"#$%&", b"()[]{}<>/\\=+-_@^~`", b"0123456789")]
_CLASSES += [(np.arange(256) >= 65) & (np.arange(256) <= 90), (np.arange(256) >= 97) & (np.arange(256) <= 122), np.arange(256) >= 128, np.arange(256) < 9]
CLASSES = np.array(_CLASSES, np.float64).T
WIDTH = CLASSES.shape[1] + 12


def _distinct(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the largest count of a value per text; h is sorted in place."""
    n = len(at) - 1
    for i in range(n):
        h[at[i] : at[i + 1]].sort()
    owner = np.repeat(np.arange(n), np.diff(at))
    head = np.ones(len(h), bool)
    head[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(head)
    run = np.diff(np.append(first, len(h)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner[first], run)
    return np.bincount(owner[first], minlength=n), most


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of WIDTH numbers per text."""
    n, size = len(offs) - 1, np.diff(offs)
    doc = np.repeat(np.arange(n), size)
    hist = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)
    per = np.maximum(size, 1)[:, None]
    h, start, end, own = bk.word_hashes(bk.LOWER[data], offs, ~bk.SPACE)
    at = bk.per_text(own, n)
    words, length = np.diff(at), np.bincount(own, end - start, n)
    long_ = np.bincount(own, end - start > 12, n)
    upper = np.bincount(own, (data[start] >= 65) & (data[start] <= 90) if len(start) else None, n) if len(start) else np.zeros(n)
    odd = np.bincount(own, ~bk.ALNUM[bk.LOWER[data[end - 1]]], n) if len(end) else np.zeros(n)
    kinds, most = _distinct(h.copy(), at)
    lines = np.ones(256, bool)
    lines[[10, 13]] = False
    lh, ls, le, lo = bk.word_hashes(data, offs, lines)
    lat = bk.per_text(lo, n)
    lkinds, _ = _distinct(lh.copy(), lat)
    nl = np.diff(lat)
    w, ln = np.maximum(words, 1), np.maximum(nl, 1)
    short = np.bincount(lo, le - ls < 40, n)
    prob = hist / per
    entropy = -(prob * np.log2(np.maximum(prob, 1e-12))).sum(1)
    own_part = np.stack([np.log1p(size), np.log1p(words), length / w, long_ / w, upper / w, odd / w, kinds / w, most / w, lkinds / ln, np.log1p(size / ln), short / ln, entropy], 1)
    return np.concatenate([hist @ CLASSES / per, own_part], 1)


def fit(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Boosted trees of complete shape: feature and threshold per inner node, value per leaf, in heap order."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        return {"feature": np.zeros((0, 0), np.int64), "cut": np.zeros((0, 0)), "leaf": np.zeros((0, 1)), "start": np.array(np.log((share + 1e-6) / (1 - share + 1e-6)))}
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    inner = 2**DEPTH - 1
    feature, cut, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    start = np.log(share / (1 - share))
    raw = np.full(len(y), start)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            base, wide = 2**depth - 1, 2**depth
            best = np.full(wide, 1e-6)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                k = (node - base) * (BINS + 1) + binned[:, f]
                gs, hs, ns = (np.bincount(k, z, wide * (BINS + 1)).reshape(wide, -1).cumsum(1) for z in (g, h, None))
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                gain = np.where((ns >= LEAST_LEAF) & (nt - ns >= LEAST_LEAF), gain, 0)[:, : len(e)]
                at = gain.argmax(1)
                top = gain[np.arange(wide), at]
                for i in np.flatnonzero(top > best):
                    best[i], feature[t, base + i], cut[t, base + i] = top[i], f, e[at[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        gs, hs = np.bincount(node - inner, g, inner + 1), np.bincount(node - inner, h, inner + 1)
        leaf[t] = RATE * gs / (hs + RIDGE)
        raw += leaf[t, node - inner]
    return {"feature": feature, "cut": cut, "leaf": leaf, "start": np.array(start)}


def predict(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    raw, rows = np.full(len(x), float(model["start"])), np.arange(len(x))
    for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"]):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        raw += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-raw))


def _features(batches):
    for b in batches:
        for lo, hi, data, offs, _ in bk.slices(b.column(1)):
            x = statistics(data, offs)
            at = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
            yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()))], names=["id", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Model from at most `most` labelled rows that are not held out; the rows, `most` times WIDTH numbers, meet on the driver."""
    ok = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 5 != 0))
    chosen = ok.groupBy(F.col(id_col).cast("long").alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select("id")), "id", "left_semi")
    seen = rows.mapInArrow(_features, "id long, x array<double>").toPandas().drop_duplicates("id").sort_values("id")
    y = chosen.toPandas().set_index("id")["y"]
    return fit(np.stack(seen["x"].to_numpy()) if len(seen) else np.zeros((0, WIDTH)), y.reindex(seen["id"]).to_numpy(np.float64))


def _score(model):
    def run(batches):
        for b in batches:
            for lo, hi, data, offs, _ in bk.slices(b.column(1)):
                s = predict(model, statistics(data, offs))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in range(len(b.columns))), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) per row."""
    model = train(docs, labels, id_col, text_col, label_col)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held_out"))
    return scored.mapInArrow(_slim(model), "id long, held_out boolean, score double, predicted int")


def _slim(model):
    score = _score(model)

    def run(batches):
        for b in score(batches):
            yield b.select(["id", "held_out", "score", "predicted"])

    return run


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs, all columns, that the classifier accepts."""
    model = train(docs, labels, id_col, text_col, label_col)
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            keep = np.concatenate([predict(model, statistics(d, o)) for _, _, d, o, _ in bk.slices(b.column(at))] or [np.zeros(0)]) >= CUT
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)

"""Embedding near-duplicates with hierarchical navigable small-world graphs, one per shard.

Vectors are linked when their labels (as text) are equal and not null, their lengths are equal, and their cosine in double precision is
at least a threshold. Null, zero, non-finite vectors and vectors with a null component link with nothing; they and rows
with a null id come back with no links. Equal vectors collapse into a class before anything else. Rows that repeat an id
are separate members of their classes and one node of a component. An empty table gives no rows; extra columns are not read.

Every label is cut by hash into shards of about SHARD_ROWS classes; a shard is one row holding its vectors and its graph
as arrays, so a hot label is many rows. Blocks of queries meet every shard of their label by an equi-join of blocks. Beams
widen for each query that finds nothing but links, and for all until an audit of hash-drawn queries against brute force passes; what the graph finds is confirmed in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytekit as bk
from quillspark.llm.shared import components, stage

SHARD_ROWS, BLOCK_ROWS, AUDIT_ROWS = 8192, 4096, 64
LINKS, BEAM = 12, 48


class Graph:
    """Layers of neighbour lists over unit vectors (float32); layer 0 has twice the links."""

    def __init__(self, x: np.ndarray, keys: np.ndarray):
        self.x = x
        n = len(x)
        u = (bk.mix(keys.astype(np.int64).view(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        self.level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(LINKS)).astype(np.int64), 8)
        order = np.lexsort((keys, -self.level))  # upper layers first: every entry point exists before it is needed
        self.entry = int(order[0]) if n else -1
        self.links = [np.full((n, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(self.level[order[0]]) + 1 if n else 0)]
        done = 1
        while done < n:
            batch = order[done : done + min(256, max(1, done))]
            self._insert(batch)
            done += len(batch)
        self._reach()

    def _insert(self, batch: np.ndarray) -> None:
        q = self.x[batch]
        start = np.full(len(batch), self.entry)
        mutual = q @ q.T
        np.fill_diagonal(mutual, -2)
        for k in range(len(self.links) - 1, -1, -1):
            here = self.level[batch] >= k
            found, sims = self.search(q, start, k, BEAM if here.any() else 1)
            start = found[:, 0].copy()
            if not here.any():
                continue
            ids, own = batch[here], mutual[np.ix_(here, here)]
            near = np.argsort(-own, axis=1)[:, : min(BEAM // 2, len(ids))]
            peers = np.where(np.take_along_axis(own, near, 1) > -2, ids[near], -1)
            cand = np.concatenate([found[here], peers], 1)
            cs = np.concatenate([sims[here], np.take_along_axis(own, near, 1)], 1)
            chosen = self._diverse(cand, cs, LINKS)
            self.links[k][ids, : chosen.shape[1]] = chosen
            self._back(k, ids, chosen)

    def _diverse(self, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Neighbours that are nearer to the node than to one chosen before; places left go to the nearest of the rest."""
        order = np.argsort(-np.where(cand >= 0, sims, -3), axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        v = self.x[np.maximum(cand, 0)]
        among = np.einsum("ncd,ned->nce", v, v, optimize=True)
        keep = np.zeros(cand.shape, bool)
        for c in range(cand.shape[1]):
            nearer = (keep[:, :c] & (among[:, c, :c] > sims[:, c : c + 1])).any(1)
            keep[:, c] = (cand[:, c] >= 0) & ~nearer & (keep[:, :c].sum(1) < most)
        rank = np.argsort(np.where(keep, 0, np.where(cand >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(cand, rank, 1).astype(np.int32)

    def _back(self, k: int, ids: np.ndarray, chosen: np.ndarray) -> None:
        src, dst = np.repeat(ids, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.lexsort((src, dst))
        src, dst = src[order], dst[order]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        width = int(min(count.max(), 64)) if len(count) else 0
        if not width:
            return
        slot = np.arange(len(dst)) - np.repeat(first, count)
        extra = np.full((len(nodes), width), -1, np.int64)
        ok = slot < width
        extra[np.repeat(np.arange(len(nodes)), count)[ok], slot[ok]] = src[ok]
        table = self.links[k]
        for lo in range(0, len(nodes), 256):
            some = nodes[lo : lo + 256]
            cand = np.concatenate([table[some], extra[lo : lo + 256]], 1).astype(np.int64)
            cand.sort(axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            sims = np.einsum("nd,ncd->nc", self.x[some], self.x[np.maximum(cand, 0)], optimize=True)
            best = self._diverse(cand, sims, table.shape[1])
            table[some, : best.shape[1]] = best
            table[some, best.shape[1] :] = -1

    def _reach(self) -> None:
        """Hook what the entry can't reach on layer 0 onto its nearest reached node."""
        n = len(self.x)
        if not n:
            return
        seen = np.zeros(n, bool)
        front = np.array([self.entry])
        seen[front] = True
        while True:
            while len(front):
                near = self.links[0][front].ravel()
                front = np.unique(near[near >= 0])
                front = front[~seen[front]]
                seen[front] = True
            lost = np.flatnonzero(~seen)
            if not len(lost):
                return
            there = np.flatnonzero(seen)
            host = there[np.argmax(self.x[there] @ self.x[lost[0]])]
            self.links[0] = np.concatenate([self.links[0], np.full((n, 1), -1, np.int32)], 1) if self.links[0][host, -1] >= 0 else self.links[0]
            self.links[0][host, -1] = lost[0]
            front = lost[:1]
            seen[front] = True

    def search(self, q: np.ndarray, start: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of layer k for all queries at once: (ids, similarities), best first, -1 where there are fewer."""
        n, m = len(self.x), len(q)
        beam = min(beam, n)
        ids = np.full((m, beam), -1, np.int64)
        sims = np.full((m, beam), -2.0, np.float32)
        open_ = np.zeros((m, beam), bool)
        seen = np.zeros((m, n), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = start, np.einsum("nd,nd->n", q, self.x[start]), True
        seen[np.arange(m), start] = True
        step = 4 if beam >= 16 else 1
        while True:
            live = np.flatnonzero(open_.any(1))
            if not len(live):
                return ids, sims
            pick = np.argsort(~open_[live], axis=1, kind="stable")[:, :step]
            real = np.take_along_axis(open_[live], pick, 1)
            open_[live[:, None], pick] = False
            near = self.links[k][np.maximum(ids[live[:, None], pick], 0)]
            near = np.where(real[:, :, None], near, -1).reshape(len(live), -1).astype(np.int64)
            near[near >= 0] = np.where(seen[np.broadcast_to(live[:, None], near.shape)[near >= 0], near[near >= 0]], -1, near[near >= 0])
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            ok = near >= 0
            used = ok.any(0)
            near, ok = near[:, used], ok[:, used]
            if not near.shape[1]:
                continue
            s = np.full(near.shape, -2.0, np.float32)
            r, c = np.nonzero(ok)
            s[r, c] = np.einsum("nd,nd->n", q[live[r]], self.x[near[r, c]])
            seen[live[r], near[r, c]] = True
            all_s = np.concatenate([sims[live], s], 1)
            best = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            sims[live] = np.take_along_axis(all_s, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), best, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], ok], 1), best, 1)

    def near(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full(len(q), self.entry)
        for k in range(len(self.links) - 1, 0, -1):
            start = self.search(q, start, k, 1)[0][:, 0]
        return self.search(q, start, 0, beam)

    def hits(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (query, node) at a similarity within float error of the threshold.

        A query whose beam holds nothing below the threshold may have more links than places: its beam is doubled until it
        does, and one of half the graph or more is a matrix product with all nodes.
        """
        rows, cols = [], []
        left = np.arange(len(q))
        while len(left):
            wider = []
            for lo in range(0, len(left), 256):
                some = left[lo : lo + 256]
                if 2 * beam >= len(self.x):
                    r, c = np.nonzero(q[some] @ self.x.T >= least - 1e-5)
                else:
                    ids, sims = self.near(q[some], beam)
                    ok = (sims >= least - 1e-5) & (ids >= 0)
                    full = ok.all(1)
                    wider.append(some[full])
                    ok &= ~full[:, None]
                    r, at = np.nonzero(ok)
                    c = ids[r, at]
                rows.append(some[r])
                cols.append(c)
            left = np.concatenate(wider) if wider else left[:0]
            beam *= 2
        return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, int), np.zeros(0, int))

    def audited(self, q: np.ndarray, least: float, recall: float = 0.99) -> tuple[np.ndarray, np.ndarray]:
        """hits() with the first beam doubled until recall of the links of AUDIT_ROWS hash-drawn queries, each link counted, is
        reached against brute force. A query's link to itself, which costs no search, isn't counted."""
        draw = np.argsort(bk.mix(np.arange(len(q), dtype=np.uint64)))[:AUDIT_ROWS]
        sims = q[draw] @ self.x.T
        true = (sims >= least) & (sims < 1 - 1e-6)
        beam = BEAM
        while 2 * beam < len(self.x):
            r, c = self.hits(q[draw], least, beam)
            if true[r, c].sum() >= recall * true.sum():
                break
            beam *= 2
        return self.hits(q, least, beam)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt(np.einsum("nd,nd->n", x, x))
    return (x / norm[:, None]).astype(np.float32), norm


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            break
    return root


def _exact(qx, qn, sx, sn, rows, cols, least):
    """Cosines in double precision of the pairs (rows, cols), a block at a time."""
    out = np.empty(len(rows), bool)
    for lo in range(0, len(rows), 1 << 15):
        r, c = rows[lo : lo + (1 << 15)], cols[lo : lo + (1 << 15)]
        out[lo : lo + (1 << 15)] = np.einsum("nd,nd->n", qx[r], sx[c]) / (qn[r] * sn[c]) >= least
    return out


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _build(least: float):
    def run(key, group):
        label, dim, shard = (k.as_py() for k in key)
        ids = np.asarray(group.column("rep"))
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        x = np.asarray(group.column("v").combine_chunks().flatten()).reshape(-1, dim)[order].astype(np.float64)
        unit, norm = _unit(x)
        g = Graph(unit, ids)
        r, c = g.audited(unit, least)
        ok = _exact(x, norm, x, norm, r, c, least)
        root = _roots(len(ids), r[ok], c[ok])
        layers = [[t.shape[1], _pack(t)] for t in g.links]
        return pa.table(
            {
                "label": [label], "dim": [dim], "shard": [shard], "ids": [_pack(ids)], "w": [_pack(np.asarray(group.column("w"))[order])], "v": [_pack(x)], "root": [_pack(root)], "entry": [g.entry],
                "widths": pa.array([[w for w, _ in layers]], pa.list_(pa.int32())), "links": pa.array([[t for _, t in layers]], pa.list_(pa.binary())),
            },
        ).cast(pa.schema([("label", pa.string()), ("dim", pa.int32()), ("shard", pa.int64()), ("ids", pa.binary()), ("w", pa.binary()), ("v", pa.binary()), ("root", pa.binary()), ("entry", pa.int64()), ("widths", pa.list_(pa.int32())), ("links", pa.list_(pa.binary()))]))

    return run


BUILT = "label string, dim int, shard long, ids binary, w binary, v binary, root binary, entry long, widths array<int>, links array<binary>"


def _meet(least: float):
    def one(row):
        dim = row["dim"]
        ids, w, root = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["w"], np.int64), np.frombuffer(row["root"], np.int64)
        x = np.frombuffer(row["v"], np.float64).reshape(-1, dim)
        qi, q = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_v"], np.float64).reshape(-1, dim)
        g = Graph.__new__(Graph)
        g.x, norm = _unit(x)
        g.entry = row["entry"]
        g.links = [np.frombuffer(t, np.int32).reshape(-1, k) for k, t in zip(row["widths"], row["links"])]
        unit, qn = _unit(q)
        r, c = g.audited(unit, least)
        groups = np.unique(np.stack([root[c], r]), axis=1)  # (cluster of the shard, query): all members are confirmed
        count, a, b = np.zeros(len(qi), np.int64), [], []
        order = np.argsort(root, kind="stable")
        bounds = np.searchsorted(root[order], np.arange(len(ids) + 1))
        heads, at = np.unique(groups[0], return_index=True)
        for head, who in zip(heads, np.split(groups[1], at[1:])):
            members = order[bounds[head] : bounds[head + 1]]
            for lo in range(0, len(members), 4096):
                some = members[lo : lo + 4096]
                cos = (q[who] @ x[some].T) / (qn[who][:, None] * norm[some][None, :])
                linked = (cos >= least) & (qi[who][:, None] != ids[some][None, :])
                count[who] += linked @ w[some]
                hit = who[linked.any(1)]
                a.append(qi[hit])
                b.append(np.full(len(hit), ids[head]))
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
        some = np.flatnonzero(count)
        return np.concatenate([qi[some], a]), np.concatenate([np.full(len(some), -1), b]), np.concatenate([count[some], np.zeros(len(a), np.int64)])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, b, n = one(row)
                yield pa.record_batch([pa.array(a), pa.array(b, mask=n > 0), pa.array(n)], names=["a", "b", "n"])

    return run


def _block(_key, group):
    dim = _key[1].as_py()
    ids = np.asarray(group.column("rep"))
    v = np.asarray(group.column("v").combine_chunks().flatten()).astype(np.float64)
    return pa.table({"label": pa.array([_key[0].as_py()], pa.string()), "dim": pa.array([dim], pa.int32()), "q_ids": pa.array([_pack(ids)], pa.binary()), "q_v": pa.array([_pack(v)], pa.binary())})


def embedding_links(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) per row: links to other vectors, smallest id reachable, whether that is the row's own."""
    v = F.col(vector_col).cast("array<double>")
    rows = stage(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v")), "vectors")
    sound = F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.where(F.coalesce(sound, F.lit(False)))
    classes = good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("w")).withColumn("dim", F.size("v"))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("c"))
    cut = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.ceil(F.col("c") / n))
    classes = stage(classes.join(sizes, ["label", "dim"]).withColumn("shard", cut(SHARD_ROWS, 1)).withColumn("block", cut(BLOCK_ROWS, 2)), "classes")
    shards = stage(classes.select("label", "dim", "shard", "rep", "w", "v").groupBy("label", "dim", "shard").applyInArrow(_build(least), BUILT), "graphs")
    blocks = stage(classes.select("label", "dim", "block", "rep", "v").groupBy("label", "dim", "block").applyInArrow(_block, "label string, dim int, q_ids binary, q_v binary"), "blocks")
    met = blocks.join(shards, ["label", "dim"]).repartition(F.xxhash64("q_ids", "shard"))
    found = stage(met.mapInArrow(_meet(least), "a long, b long, n long"), "found")
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    belongs = good.join(classes.select("label", "v", "rep", "w"), ["label", "v"]).select("id", "rep", "w")
    own = stage(belongs.join(counts.withColumnRenamed("a", "rep"), "rep", "left").select("id", "rep", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n")), "own")
    comp = components(found.where("n = 0").select("a", "b").union(own.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))))
    links = own.groupBy("id").agg(F.max("n").alias("n_links"))
    out = rows.select("id").join(links, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    root = F.coalesce("root", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"))

"""Benchmark decontamination: a BM25 inverted index of test items, block-max pruning, and a check of question and answer overlap.

Words are runs of digits, letters and non-ASCII characters, lower-cased. A test item is cut into pieces of at most PIECE words;
every training text is cut into passages of WINDOW words that overlap by half, so a piece stands whole in some passage. A
piece's score in a passage is its BM25 weight of the words they share, as a share of the weight of all its words; all pieces
at LEAST_SCORE or more are retrieved. Passages whose words' largest weights don't add up to that are passed over; for the
others, blocks of pieces whose block maxima don't add up are; the rest is scored exactly. No candidate is capped.

A retrieved item leaks when the text holds at least OVERLAP of the item's five-word shingles, or of its question's: the last
sentence (or the last quarter of the words, where there is but one) is the answer, what stands before it the question. Items of
fewer than five words are one shingle. A question alone, or one in scattered pieces, can hold less than LEAST_SCORE of a piece's
weight: such texts are found by the shingles they share with an item, counted for every text, and scored after that.

A null or empty text or item gives no rows. Rows that repeat an id are reported together (the best of each item); null ids
are reported under null. Extra columns are not read. The index is built per part of at most PART_WORDS item words and broadcast;
benchmarks beyond that take several passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytekit as bk
from quillspark.llm.minhash import MIXERS

PIECE, WINDOW, BLOCK, PART_WORDS = 40, 96, 32, 1_000_000
#: Bytes of texts scored at once: the pairs of passages and words they make are the operator's memory.
SLICE = 512 << 10
K1, LENGTH, LEAST_SCORE, OVERLAP, SHINGLE = 1.2, 0.75, 0.5, 0.8, 5


def _shingles(h: np.ndarray) -> np.ndarray:
    """Distinct hashes of five-word runs; of the whole, where it is shorter."""
    k = min(SHINGLE, len(h))
    if not k:
        return h
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        acc += h[j : len(h) - k + 1 + j] * MIXERS[j]
    return np.unique(bk.mix(acc))


def build_index(items: list[tuple[int, str]]) -> dict:
    """Postings by word hash, impacts relative to a piece's own weight, and block maxima."""
    words, answers, ids = [], [], []
    for item, text in items:
        data = np.frombuffer(pc.utf8_lower(pa.scalar(text or "")).as_py().encode(), np.uint8)
        h, start, _, _ = bk.word_hashes(data, np.array([0, len(data)]), bk.ALNUM)
        if not len(h):
            continue
        stops = [m + 1 for m in np.flatnonzero(np.isin(data, [33, 46, 63])).tolist()]
        cuts = [int(np.searchsorted(start, s)) for s in stops]
        cuts = [c for c in cuts if 0 < c < len(h)]
        words.append(h)
        answers.append(cuts[-1] if cuts else max(1, len(h) * 3 // 4))
        ids.append(item)
    piece, owner = [], []
    for i, h in enumerate(words):
        for part in np.array_split(h, -(-len(h) // PIECE)):
            piece.append(part)
            owner.append(i)
    n = len(piece)
    size = np.array([len(p) for p in piece], np.float64)
    rows = np.repeat(np.arange(n), size.astype(int))
    pair = np.unique(np.stack([np.concatenate(piece), rows.astype(np.uint64)]), axis=1, return_counts=True) if n else (np.zeros((2, 0), np.uint64), np.zeros(0))
    term_hash, doc, tf = pair[0][0], pair[0][1].astype(np.int64), pair[1].astype(np.float64)
    vocab, term = np.unique(term_hash, return_inverse=True)
    df = np.bincount(term, minlength=len(vocab))
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - LENGTH + LENGTH * size[doc] / max(size.mean() if n else 1, 1)))
    impact /= np.bincount(doc, impact, n)[doc] if n else 1
    order = np.lexsort((doc, term))
    term, doc, impact = term[order], doc[order], impact[order]
    blocks = -(-n // BLOCK)
    key, inv = np.unique(term * max(blocks, 1) + doc // BLOCK, return_inverse=True)
    block_max = np.zeros(len(key))
    np.maximum.at(block_max, inv, impact)
    most = np.zeros(len(vocab))
    np.maximum.at(most, term, impact)
    whole, question = [_shingles(h) for h in words], [_shingles(h[:a]) for h, a in zip(words, answers)]
    longer = [i for i, h in enumerate(words) if len(h) > SHINGLE]
    gram = np.concatenate([whole[i] for i in longer]) if longer else np.zeros(0, np.uint64)
    asked = np.concatenate([np.isin(whole[i], question[i]) for i in longer]) if longer else np.zeros(0, bool)
    of = np.repeat(np.array(longer, np.int64), [len(whole[i]) for i in longer])
    order = np.argsort(gram, kind="stable")
    gram, at_gram = np.unique(gram[order], return_index=True)
    return {
        "gram": gram, "gram_at": np.append(at_gram, len(order)), "gram_item": of[order], "gram_asked": asked[order],
        "vocab": vocab, "most": most, "doc": doc, "impact": impact, "at": np.searchsorted(term, np.arange(len(vocab) + 1)), "block": key % max(blocks, 1), "block_max": block_max, "block_at": np.searchsorted(key // max(blocks, 1), np.arange(len(vocab) + 1)),
        "blocks": max(blocks, 1), "owner": np.array(owner, np.int64), "ids": np.array(ids, np.int64),
        "question": question, "answer": [_shingles(h[a:]) for h, a in zip(words, answers)], "whole": whole, "size": [len(h) for h in words],
    }


def _spread(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at[w]..at[w+1] of all w in which, and the index in which each comes from."""
    n = at[which + 1] - at[which]
    src = np.repeat(np.arange(len(which)), n)
    return np.repeat(at[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), src


def retrieve(index: dict, h: np.ndarray, doc: np.ndarray, n: int, least: float = LEAST_SCORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, piece, score) of every passage and piece that score at least `least`."""
    none = np.zeros(0, np.int64)
    vocab = index["vocab"]
    if not len(h) or not len(vocab):
        return none, none, np.zeros(0)
    place = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    hit = np.flatnonzero(vocab[place] == h)
    term, own = place[hit], doc[hit]
    step = WINDOW // 2
    first = bk.per_text(doc, n)
    pieces = -(-np.diff(first) // step)  # half windows per text; passage k is halves k and k+1
    base = np.cumsum(pieces) - pieces
    half = base[own] + (hit - first[own]) // step
    total = int(pieces.sum())
    bound = np.bincount(half, index["most"][term], total)
    same = np.zeros(total, bool)
    last = base + pieces - 1
    same[last[pieces > 0]] = True
    window = bound + np.where(same, 0, np.append(bound[1:], 0))
    keep = window >= least
    pair_w = np.concatenate([half, half - 1])
    ok = pair_w >= 0
    ok[len(half) :] &= ~same[np.maximum(pair_w[len(half) :], 0)]
    ok &= keep[np.maximum(pair_w, 0)]
    pair = np.unique(pair_w[ok] * len(vocab) + np.concatenate([term, term])[ok])
    if not len(pair):
        return none, none, np.zeros(0)
    w, t = pair // len(vocab), pair % len(vocab)
    pos, src = _spread(index["block_at"], t)
    key, inv = np.unique(w[src] * index["blocks"] + index["block"][pos], return_inverse=True)
    live = key[np.bincount(inv, index["block_max"][pos]) >= least - 1e-9]
    some = np.isin(w, live // index["blocks"])
    w, t = w[some], t[some]
    pos, src = _spread(index["at"], t)
    item = index["doc"][pos]
    inside = np.isin(w[src] * index["blocks"] + item // BLOCK, live)
    pieces_n = len(index["owner"])
    key, inv = np.unique(w[src][inside] * pieces_n + item[inside], return_inverse=True)
    score = np.bincount(inv, index["impact"][pos][inside])
    key, score = key[score >= least - 1e-9], score[score >= least - 1e-9]
    text = np.searchsorted(base + pieces, key // pieces_n, side="right")
    return text, key % pieces_n, score


def held(index: dict, h: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """(text, item) of every text that holds OVERLAP of the shingles of an item, or of its question."""
    gram, n = index["gram"], len(h) - SHINGLE + 1
    if n <= 0 or not len(gram):
        return []
    acc = np.full(n, SHINGLE, np.uint64)
    for j in range(SHINGLE):
        acc += h[j : n + j] * MIXERS[j]
    acc = bk.mix(acc)
    place = np.minimum(np.searchsorted(gram, acc), len(gram) - 1)
    hit = np.flatnonzero((gram[place] == acc) & (doc[:n] == doc[SHINGLE - 1 :]))
    pair = np.unique(doc[hit] * len(gram) + place[hit])
    pos, src = _spread(index["gram_at"], pair % len(gram))
    items = len(index["whole"])
    key, inv = np.unique((pair // len(gram))[src] * items + index["gram_item"][pos], return_inverse=True)
    both, asked = np.bincount(inv, minlength=len(key)), np.bincount(inv, index["gram_asked"][pos], len(key))
    out = []
    for k, c, q in zip(key.tolist(), both.tolist(), asked.tolist()):
        i = k % items
        if c / len(index["whole"][i]) >= OVERLAP or q / max(1, len(index["question"][i])) >= OVERLAP:
            out.append((k // items, i))
    return out


def best_score(index: dict, h: np.ndarray, item: int) -> float:
    """The largest score of a piece of one item in the passages of one text."""
    best, step = 0.0, WINDOW // 2
    for piece in np.flatnonzero(index["owner"] == item).tolist():
        post = np.flatnonzero(index["doc"] == piece)
        term = np.searchsorted(index["at"], post, side="right") - 1
        words, impact = index["vocab"][term], index["impact"][post]
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        hit = np.flatnonzero(words[at] == h)
        half = hit // step
        pair = np.unique(np.concatenate([half, np.maximum(half - 1, 0)]) * len(words) + np.concatenate([at[hit], at[hit]]))
        if len(pair):
            best = max(best, float(np.bincount(pair // len(words), impact[pair % len(words)]).max()))
    return best


def found_in(index: dict, column: pa.Array) -> list[tuple]:
    """(row, item_id, score, question_overlap, answer_overlap, overlap) of the leaks in a slice of texts."""
    data, offs, _ = bk.utf8(pc.utf8_lower(column))
    h, _, _, doc = bk.word_hashes(data, offs, bk.ALNUM)
    text, piece, score = retrieve(index, h, doc, len(column))
    at = bk.per_text(doc, len(column))
    rows = {}
    for i, p, s in zip(text.tolist(), piece.tolist(), score.tolist()):
        k = (i, int(index["owner"][p]))
        rows[k] = max(rows.get(k, 0.0), s)
    for i, item in held(index, h, doc):
        if (i, item) not in rows:
            rows[i, item] = best_score(index, h[at[i] : at[i + 1]], item)
    out, seen, of = [], None, -1
    for (i, item), s in sorted(rows.items()):
        if i != of:
            seen, of = _shingles(h[at[i] : at[i + 1]]), i
        words = h[at[i] : at[i + 1]]
        share = lambda z: float(np.isin(z, seen, kind="sort").mean()) if len(z) else 0.0  # noqa: E731, B023
        if index["size"][item] <= SHINGLE:
            whole = question = answer = float(_short(index["whole"][item][0], index["size"][item], words))
        else:
            whole, question, answer = share(index["whole"][item]), share(index["question"][item]), share(index["answer"][item])
        if whole >= OVERLAP or question >= OVERLAP:
            out.append((i, int(index["ids"][item]), s, question, answer, whole))
    return out


def _leaks(shared):
    def run(batches):
        for b in batches:
            for lo, hi, *_ in bk.slices(b.column(1), SLICE):
                out = found_in(shared.value, b.column(1).slice(lo, hi - lo))
                if out:
                    i, *rest = zip(*out)
                    yield pa.record_batch([b.column(0).slice(lo, hi - lo).take(pa.array(i)), *(pa.array(c) for c in rest)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "overlap"])

    return run


def _clean(shared, at):
    def run(batches):
        for b in batches:
            keep = np.ones(len(b), bool)
            for lo, hi, *_ in bk.slices(b.column(at), SLICE):
                keep[[lo + r[0] for r in found_in(shared.value, b.column(at).slice(lo, hi - lo).cast(pa.string()))]] = False
            yield b.filter(pa.array(keep))

    return run


def _short(shingle: np.uint64, k: int, words: np.ndarray) -> bool:
    """Whether an item of k words, five at most, stands in the text."""
    acc = np.full(max(0, len(words) - k + 1), k, np.uint64)
    for j in range(k):
        acc += words[j : len(words) - k + 1 + j] * MIXERS[j]
    return bool((bk.mix(acc) == shingle).any())


def _indexes(benchmark: DataFrame, item_col: str, item_text: str):
    """Broadcast indexes of the test items, one per PART_WORDS of their words."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    size = items.agg(F.sum(F.length("t") / 4 + 1)).first()[0] or 0
    parts = int(size // PART_WORDS) + 1
    for p in range(parts):
        part = items.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == p).distinct().orderBy("i", "t").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(build_index([(r["i"], r["t"]) for r in part]))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, overlap) of every leak."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for shared in _indexes(benchmark, item_col, item_text):
        new = rows.mapInArrow(_leaks(shared), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, overlap double")
        found = new if found is None else found.union(new)
    best = [F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap", "overlap")]
    return found.groupBy("doc_id", "item_id").agg(*best)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose own text leaks no item: ids aren't read, so they may be null or repeat."""
    for shared in _indexes(benchmark, item_col, item_text):
        docs = docs.mapInArrow(_clean(shared, docs.columns.index(text_col)), docs.schema)
    return docs

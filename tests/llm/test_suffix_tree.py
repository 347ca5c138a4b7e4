"""The suffix tree against plain Python: counts in dictionaries, divergence tests, and the longest retained suffix of every place."""

import math
import re
import tracemalloc
import zlib
from collections import defaultdict
from types import SimpleNamespace

import pytest

from quillspark.llm import suffixtree as st

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _symbols(t):
    return b" ".join(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").translate(LOWER).encode())) + b"\n"


def _scores(rows):
    """{text: log10 probability} by the definition in the module's docstring."""
    count = [defaultdict(lambda: defaultdict(int)) for _ in range(st.DEPTH + 1)]
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            s = b"\n" * st.DEPTH + _symbols(t)
            for at in range(st.DEPTH, len(s)):
                for d in range(st.DEPTH + 1):
                    count[d][s[at - d : at]][s[at]] += 1

    def prob(ctx, sym):
        d = len(ctx)
        back = prob(ctx[1:], sym) if d else 1 / 252
        seen = count[d].get(ctx)
        if not seen:
            return back if d else 1 / 252
        t, k = sum(seen.values()), len(seen) if d else 126
        return seen.get(sym, 0) / (t + k) + k / (t + k) * back

    kept = {b""}
    for d in range(1, st.DEPTH + 1):
        for ctx, seen in count[d].items():
            t = sum(seen.values())
            gain = sum(c * math.log(c / t / prob(ctx[1:], s)) for s, c in seen.items())
            if d <= st.LOW or (t >= st.LEAST and gain >= st.GAIN):
                kept |= {ctx[j:] for j in range(d)}
    out = {}
    for _, t in rows:
        s, total = b"\n" * st.DEPTH + _symbols(t), 0.0
        for at in range(st.DEPTH, len(s)):
            ctx = next(s[at - d : at] for d in range(st.DEPTH, -1, -1) if s[at - d : at] in kept)
            total += math.log10(prob(ctx, s[at]))
        out[t] = total
    return out


@pytest.mark.parametrize("small", [False, True])
def test_scores_match_the_definition(spark, docs, rows, monkeypatch, small):
    if small:  # many groups, several rounds of merges, several salts
        monkeypatch.setattr(st, "GROUP_BYTES", 6000)
        monkeypatch.setattr(st, "FAN", 3)
    want = _scores([(r[0], r[1]) for r in rows])
    texts = {r[0]: r[1] for r in rows}
    got = st.suffix_tree_scores(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r["score"], want[texts[r["id"]]], rel_tol=1e-5)


def test_distributions_sum_to_one():
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.choice(list(b"abc d"), 5000).astype(np.uint8)
    code, _ = st.coded(data, np.array([0, 2000, 5000]))
    k, c = np.unique(code, return_counts=True)
    pair, at = np.unique(st.context(k, st.LOW) << 8 | k & 255, return_inverse=True)
    low = st.low_levels(pair, np.bincount(at, c))
    levels = [*low, *st.deep_levels(k, c, low)]
    alphabet = [b for b in range(256) if b not in (9, 11, 12, 13)]
    assert len(alphabet) == st.ALPHABET
    for ctx in (*np.unique(k >> 8)[:20], 0x7A7A7A7A7A7A):
        assert math.isclose(st.probabilities(levels, (int(ctx) << 8) + np.array(alphabet)).sum(), 1, rel_tol=1e-9)


def test_tree_grows_with_the_input_and_beats_word_counts(spark):
    """On real prose, twice the text retains more contexts, and held-out texts are likelier than by their words alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

    def contexts(part):
        rows = part.selectExpr("doc_id AS id", "false AS held_out", "text").coalesce(1)
        codes = rows.mapInArrow(st._groups, st.TEXTS).mapInArrow(st._count(8), st.CODES)
        return st.tree(codes, 1, 8)[1].groupBy().sum("deepest").first()[0]

    assert contexts(docs) > 1.3 * contexts(docs.where("doc_id % 3 = 0"))
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = st.suffix_tree_scores(docs).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert r["s"] > r["b"]


def test_texts_that_all_are_held_out(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    got = st.suffix_tree_scores(spark.createDataFrame([(i, "Ab c") for i in ids], "doc_id long, text string")).collect()
    assert all(math.isclose(r["score"], 5 * math.log10(1 / 252), rel_tol=1e-6) and r["train_tokens"] == 0 for r in got)


def test_strings_of_odd_texts():
    import numpy as np

    texts = [b"", b" \t ", b"a", b"  Ab\n\x00c  ", b"x\x0b\x0cy", "\u00e9 \u4f60\u597d".encode(), b"", b"long words and  blanks "]
    want = []
    for t in texts:
        s = b"\n" * st.DEPTH + b" ".join(re.findall(rb"[^\x20\x09-\x0D]+", t.lower())) + b"\n"
        want.append([int.from_bytes(s[at - st.DEPTH : at][::-1] + s[at : at + 1], "big") for at in range(st.DEPTH, len(s))])
    code, o = st.coded(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert [code[i:j].tolist() for i, j in zip(o, o[1:])] == want


def test_memory_of_a_group(monkeypatch):
    """The arrays of a whole group take at most 16 bytes for each byte of its text while it is counted, and 24 while it is scored."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(st, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"])
    held = pa.array([zlib.crc32(str(i).encode()) % 5 == 1 for i in texts.column(0).to_pylist()])
    group = next(st._groups(pa.table([texts.column(0), held, texts.column(1).cast(pa.string())], names=["id", "held_out", "text"]).to_batches()))
    size = sum(len(t) for b in pa.ipc.open_stream(group.column(1)[0].as_buffer()) for t in map(str.encode, b.column(2).to_pylist()))
    assert size > st.GROUP_BYTES / 2

    def peak(f):
        tracemalloc.start()
        try:
            return f(), tracemalloc.get_traced_memory()[1] / size
        finally:
            tracemalloc.stop()

    (counted,), took = peak(lambda: list(st._count(8)([group])))
    assert took < 16
    strings = counted.filter(pa.array([b < 8 for b in counted.column(1).to_pylist()]))
    assert strings.column(3).nbytes < sum(len(st._unpacked(c)) for c in strings.column(2)), "a count takes less than a byte"
    found = [np.ones(len(st._unpacked(c)), np.float32 if b < 8 else st.COUNT) for b, c in zip(counted.column(1).to_pylist(), counted.column(2))]
    answers = pa.table([counted.column(0), counted.column(1), pa.array(st._pack(*found), pa.binary())], names=["grp", "bucket", "found"])
    scored, took = peak(lambda: st._score(8)((pa.scalar(0),), pa.Table.from_batches([group]), answers))
    assert took < 24
    assert scored.column("n_known").equals(scored.column("n"))

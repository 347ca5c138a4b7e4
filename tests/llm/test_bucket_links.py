"""A text whose only link is to the member that a bucket's texts are compared by."""

import random

from quillspark.llm import minhash


def test_near_copy_of_the_last_document_is_found(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(60):  # a template's texts under the threshold from one another, but for the last two, which share nothing that others haven't
        t = list(base)
        for j in rng.sample(range(0, 290, 3), 10 if i < 58 else 3):
            t[j] = f"x{i}y{j}"
        texts.append(t)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in texts]
    links = {(a, b) for a in range(60) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert links == {(59, 58)}
    for pivots, part in ((1, 7), (2, 256)):  # also where the bucket's members are dealt in parts
        monkeypatch.setattr(minhash, "PART", part)
        got = {r["id"]: r["component_id"] for r in minhash.near_duplicates(df, 3, 85, pivots=pivots).collect()}
        assert got == {i: min(i, 58) for i in range(60)}

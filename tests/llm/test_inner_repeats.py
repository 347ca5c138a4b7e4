"""Strings that repeat within one document, against brute force."""

import numpy as np
import pytest

from quillspark.llm import suffixes


@pytest.mark.parametrize("per_shard", [2000, 2])
def test_periodic_text_loses_its_inner_repeats(spark, monkeypatch, per_shard):
    monkeypatch.setattr(suffixes, "SHARD_SEGMENTS", per_shard)
    words = " ".join(f"w{i * i % 977}" for i in range(60))
    texts = ["a" * 150, "b" * 499, "-" * 120, "-" * 120, "x" + "-" * 120, "Eran. " * 30, words, words + "c" * 131 + words, "abcdefghijklmnopqrstuvwxyz0123456789" * 5, "d" * 100, "é" * 80]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (5, texts[5])]
    length, seen, want = 100, {}, {}
    for i, t in enumerate(texts):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen.setdefault(b[s : s + length], (i, s)) != (i, s):
                gone[s : s + length] = True
        want[i] = bytes(np.frombuffer(b, np.uint8)[~gone])
    got = suffixes.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()
    assert len(got) == len(rows)
    assert all(bytes(r["kept"]) == want[r["id"]] for r in got)
    assert len(want[0]) == 1 and len(want[1]) == 1 and len(want[2]) == 1

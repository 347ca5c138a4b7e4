"""Texts that hold a question without its answer."""

import numpy as np

from quillspark.llm import bytekit as bk
from quillspark.llm import decontaminate


def _items():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))
    text = lambda n: " ".join(word() for _ in range(n))
    return [(k, f"{text(9 + k)}. {text(25)}.") for k in range(6)], text


def test_question_alone_leaks(spark):
    items, text = _items()
    docs = [(k, f"{text(150)} {t.split('.')[0]} {text(80)}") for k, t in items]  # the smaller part of its item
    apart = items[5][1].split(".")[0].split()
    docs += [(50, " ".join(apart[:9]) + " " + text(200) + " " + " ".join(apart[4:]))]  # in two passages
    docs += [(60, " ".join(reversed(items[0][1].split(".")[0].split()))), (61, text(300)), (62, "")]
    left = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(left, bench).collect()}
    assert set(got) == {(k, k) for k in range(6)} | {(50, 5)}
    assert all(r["question_overlap"] >= 0.8 and 0 < r["score"] < 0.5 for r in got.values())
    assert [r["doc_id"] for r in decontaminate.decontaminated(left, bench).orderBy("doc_id").collect()] == [60, 61, 62]


def test_score_of_one_item_is_that_of_retrieval():
    items, text = _items()
    index = decontaminate.build_index(items)
    for k, t in items:
        data = np.frombuffer(f"{text(100)} {t} {text(60)} {t[:90]}".encode(), np.uint8)
        h, _, _, doc = bk.word_hashes(data, np.array([0, len(data)]), bk.ALNUM)
        _, piece, score = decontaminate.retrieve(index, h, doc, 1, 0.01)
        assert np.isclose(score[index["owner"][piece] == k].max(), decontaminate.best_score(index, h, k))

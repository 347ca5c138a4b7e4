"""Exact copies of short documents."""

from quillspark.llm import chunks


def test_later_copies_of_short_documents_go(spark):
    short = "A note of only forty-odd bytes in its text."
    texts = [short, "another text that nothing else repeats here", short, short + " And more behind it.", "tiny", "tiny"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r for r in chunks.substring_dedup(df).collect()}
    assert [got[i]["n_removed"] for i in range(6)] == [0, 0, len(short), 0, 0, 4]
    assert got[2]["first_ids"] == [0] and got[5]["first_ids"] == [4] and got[1]["first_ids"] == []

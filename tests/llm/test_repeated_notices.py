"""A short notice that a text repeats."""

from quillspark.llm import licenses


def test_repeated_notice_keeps_its_label(spark):
    one = "all rights reserved"
    texts = [one, f"{one} {one} {one}", f"{one} now {one}", " ".join([one] * 20), "all rights all rights", "reserved rights all"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: (r["labels"], r["score"]) for r in licenses.license_scan(df).collect()}
    assert all(got[i] == ("all-rights-reserved", 1.0) for i in range(4))
    assert all(got[i][0] == "" for i in (4, 5))

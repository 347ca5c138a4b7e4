"""The pipeline's stages against what each operator says on the stage's own input."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import decontaminate, minhash, mixing, quality, queries, secrets


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = os.path.join(root, str(k))
        f(spark, docs[-1], sf).write.parquet(path)
        docs.append(spark.read.parquet(path))
    return docs


def ids(df, col="doc_id"):
    return sorted(r[0] for r in df.select(col).collect())


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "secrets", "mix"]
    assert all(d.columns == stages[0].columns for d in stages[:5])


def test_each_stage_keeps_what_its_operator_accepts(spark, sf, stages):
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    scored = quality.quality_scores(stages[0], labels)
    assert ids(stages[1]) == ids(scored.where("predicted = 1"), "id")
    assert ids(stages[2]) == ids(minhash.near_duplicates(stages[1], 5, 80).where("kept"), "id")
    leaking = {r["doc_id"] for r in decontaminate.leaks(stages[2], bench).collect()}
    assert ids(stages[3]) == sorted(set(ids(stages[2])) - leaking)
    assert ids(stages[4]) == ids(stages[3])
    found = secrets.secret_spans(stages[4]).where(F.exists("spans", lambda s: s["kind"] != "crf"))
    assert found.count() == 0
    taken = mixing.mix_sources(stages[4])
    copies = taken.select("id", F.explode("shards").alias("shard"))
    assert sorted(map(tuple, stages[5].select("doc_id", "shard").collect())) == sorted(map(tuple, copies.collect())) and stages[5].count() > 0
    texts = dict(map(tuple, stages[4].select("doc_id", "text").collect()))
    assert all(texts[r["doc_id"]] == r["text"] for r in stages[5].collect())


@pytest.mark.parametrize("k", range(5))
def test_stages_bear_odd_rows(spark, sf, docs, rows, none, k):
    """Nulls, empty and very long texts, repeated rows, an empty table, and columns named like the operators' own."""
    name, f = corpus_pipeline.STAGES[k]
    odd = docs.withColumn("shard", F.lit("x")).withColumn("h", F.lit(1)).withColumn("rid", F.lit(2)).withColumn("size", F.lit(3))
    got = f(spark, odd, sf).collect()
    assert f(spark, none, sf).count() == 0
    texts = [r["text"] for r in got]
    if name == "near_dedup":
        assert sum(r["doc_id"] is None for r in got) == 1 and texts.count(rows[20][1]) == 2 and texts.count(rows[0][1]) == 2
    if name == "decontaminate":
        assert len(got) == len(rows)
    if name == "secrets":
        assert len(got) == len(rows) and not any("24be64439e3e" in (t or "") for t in texts)
    if name == "mix":
        assert {type(r["shard"]) for r in got} == {int} and {r["text"] for r in got} <= {r[1] for r in rows}
    assert all((r["h"], r["rid"], r["size"], r["id"]) == (1, 2, 3, "clash") for r in got if r["doc_id"] is not None)


def test_only_the_leaking_row_of_a_null_id_goes(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    item = bench.where("length(text) > 100").first()["text"]
    df = spark.createDataFrame([(None, f"before {item} after"), (None, "nothing of that"), (7, "a"), (7, f"x {item}")], "doc_id long, text string")
    assert sorted(r["text"] for r in corpus_pipeline.decontaminate(spark, df, sf).collect()) == ["a", "nothing of that"]


def test_queries_and_sql_agree_in_names():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))

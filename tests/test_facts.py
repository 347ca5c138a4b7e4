"""Facts on hand-made relations: empty sides, ties, unknown values, stored relations that aren't whole."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import facts as fc
from quillspark.sources import sidecar


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_edges_of_a_pair_are_one_whatever_their_direction(spark):
    schema = "a long, b long, key long, weight long"
    stored = spark.createDataFrame([(1, 2, 9, 5), (4, 3, 9, 6)], schema)
    new = spark.createDataFrame([(2, 1, 1, 7), (1, 2, 2, 8), (5, 5, 1, 1)], schema)
    assert rows(fc.upserted_edges(stored, new)) == [(1, 2, 8), (3, 4, 6), (5, 5, 1)]
    assert rows(fc.upserted_edges(stored.limit(0), new.limit(0))) == []


def test_faults_of_a_graph(spark):
    nodes = spark.range(1, 5)
    sound = [(1, 2, 3.0), (2, 1, 3.0)]
    graph = lambda e: dict(fc.graph_faults(nodes, spark.createDataFrame(e, "src long, dst long, weight double")).collect())
    assert set(graph(sound).values()) == {0}
    assert graph([*sound, (1, 9, 1.0), (3, 3, 1.0), (4, 1, None), (2, 1, 4.0)]) == {"unknown node": 1, "loop": 1, "no weight": 1, "one way": 2, "repeated": 1, "unequal weights": 1}


def test_jaccard_of_names(spark):
    df = spark.createDataFrame([(["A", "b"], ["a", "B", "B"]), ([], []), (None, ["a"]), (["a"], ["a", "c"])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(fc.name_jaccard(F.col("x"), F.col("y"))).collect()] == [1.0, 0.0, 0.0, 0.5]


def test_seeds_and_ratings(spark):
    said = ["a:1", " a:1 ", "a: 1", "a:", ":1", "a:1:2", "a:99999999999999999999", "", None]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").select(fc.seed_of(F.col("s"))).collect()]
    assert [g and tuple(g) for g in got] == [("a", 1), ("a", 1)] + [None] * 7
    got = spark.createDataFrame([(s,) for s in ["g", "Z", "Explicit", None]], "s string").select(fc.stored_rating(F.col("s"))).collect()
    assert [r[0] for r in got] == ["General Audiences", "Z", "Explicit", None]


def test_standings_without_duels(spark):
    got = fc.explanation_standings(spark.createDataFrame([], "winner string")).collect()
    assert [tuple(r) for r in got] == [("tags", 0, 0, 0, 0, 1.0, "too few"), ("readers", 0, 0, 0, 0, 1.0, "too few")]


def test_stored_relations_are_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id long, tag string")
    path = str(tmp_path / "kept")
    sidecar.save(df, path, "terms", 3)
    got, total = sidecar.load(spark, path, "terms")
    assert rows(got) == rows(df) and total == 3
    sidecar.save(df.limit(0), str(tmp_path / "none"), "terms")
    assert sidecar.load(spark, str(tmp_path / "none"), "terms")[0].count() == 0
    with pytest.raises(sidecar.SidecarError):
        sidecar.load(spark, path, "edges")
    df.limit(1).write.mode("append").parquet(f"{path}/rows")
    with pytest.raises(sidecar.SidecarError):
        sidecar.load(spark, path, "terms")
    with pytest.raises(sidecar.SidecarError):
        sidecar.of_one_width(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>"))

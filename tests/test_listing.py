import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import hashing
from quillspark.operators import listing as ls
from quillspark.operators import pools, ranking
from quillspark.operators import state as st


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").select("i", f(F.col("s")).alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


def test_names(spark):
    assert column(spark, ["Worm - Fandom", "x (Anime)", "dark (fix-it)", "(anime) x", "", None, "y (fandom)", "bluey (cartoon & comics)"], ls.looks_like_universe) == [True, True, False, False, False, None, True, True]
    assert column(spark, ["A B - All Media Types", "A B (book)", "(book)", "plain", " X - fandom "], ls.canonical) == ["a b", "a b", "(book)", "plain", "x"]
    df = spark.createDataFrame([("Naruto - Fandom",), ("naruto - freeform",), ("Naruto - somebody",), ("other - somebody",), ("Star Wars (movie)",), ("z",)], "tag string")
    got = {r["tag"]: (r["universe"], r["base"]) for r in ls.by_shape(df).collect()}
    assert got == {"Naruto - Fandom": (True, "naruto"), "naruto - freeform": (False, "naruto"), "Naruto - somebody": (True, "naruto"), "other - somebody": (False, ""), "Star Wars (movie)": (True, "star wars"), "z": (False, "")}
    tags = spark.createDataFrame([(["a", "B (book)", "C - fandom"],), (["a"],)], "t array<string>")
    assert [r["g"] for r in tags.select(ls.group_key(F.col("t")).alias("g")).collect()] == ["b", None]


def test_titles_and_authors(spark):
    titles = ["(High School) Magician of Darkness", "[AB] Lord", "A Note [M | I-C]", "(un)Wholesome Want", "(Hiatus)", "Open (bracket", "The_Dark"]
    assert column(spark, titles, ls.title_key) == ["magician of darkness", "lord", "a note", "wholesome want", "hiatus", "open bracket", "the dark"]
    assert column(spark, ["aT (Dirk_G)", "One, Two", "", "Solo"], ls.author_keys) == [["at", "dirk g"], ["one", "two"], [], ["solo"]]
    assert column(spark, ["jan", "Sept", "12", "13", "ju", None, "December"], ls.month_of) == [1, 9, 12, None, None, None, 12]
    assert column(spark, ["3/3", "3/?", "3", None, " 4 / 4 "], ls.chapters_complete) == [True, False, False, False, True]
    assert column(spark, ["https://x.org/works/12?y", "/page/7", "/tags/1", None], ls.work_id_of) == [12, 7, 0, 0]
    assert column(spark, ["one two three four five six seven", "short", "x" * 30], ls.short_label) == ["one two three four five", "short", "x" * 26]
    assert column(spark, ["The (Big) -- of 'fix-it'"], ls.label_words) == [["the", "big", "fix-it"]]
    times = column(spark, ["2024-01-02 03:04:05", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.123456+00:00", "2024-01-02", "junk", None], st.parsed_time)
    day = datetime.datetime(2024, 1, 2)
    assert times[3:] == [day, None, None] and times[0] == times[1] == day.replace(hour=3, minute=4, second=5) and times[2].microsecond == 123456


def test_hashes(spark):
    assert hashing.fnv1a64(pd.Series(["", "a", "é"])).tolist()[:2] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C]
    df = spark.createDataFrame([("a",), (None,)], "s string").select(hashing.fnv_bucket(F.col("s"), 256).alias("b"), hashing.owner_key(F.col("s"), b"k").alias("k")).collect()
    assert df[0]["b"] == 0xAF63DC4C8601EC8C % 256 and df[1]["b"] is None and len(df[0]["k"]) == 64 and df[1]["k"] is None


def test_default_weights_and_their_checks():
    assert np.isclose(sum(ranking.DEFAULT_TUNE.values()), 1.9111)
    assert pools.checked_tune({"walk": 0.5})["walk"] == 0.5
    for bad in ({"nope": 1.0}, {"walk": -1.0}, {"walk": float("nan")}):
        with pytest.raises(ValueError):
            pools.checked_tune(bad)


def test_pool_reserves_places_for_readers(spark):
    works = spark.range(40).withColumnRenamed("id", "id")
    tags = spark.createDataFrame([(i, "t", "x") for i in range(20)] + [(0, "u", "x"), (1, "u", "x")], "work_id long, tag string, tag_type string")
    reads = spark.createDataFrame([(1, 0), (1, 30), (2, 0), (2, 30), (2, 31)], "user_id long, work_id long")
    got = pools.candidate_pool(works, tags, reads, None, spark.createDataFrame([(0,)], "seed long"), 8).orderBy("place").collect()
    assert [r["id"] for r in got] == [1, 2, 3, 4, 5, 6, 7, 30]


def test_pool_gives_sources_what_is_left(spark):
    """Few works by tags: readers and the walk fill all places, not only a reserve; the walk reserves none; one place is the tags'."""
    works = spark.range(40)
    tags = [(0, "t", "x"), (1, "t", "x"), (2, "t", "x"), *((i, "w", "x") for i in range(30, 36)), (99, "t", "x"), (98, "w", "x")]
    tags = spark.createDataFrame(tags, "work_id long, tag string, tag_type string")
    reads = spark.createDataFrame([(u, w) for u in (1, 2) for w in (0, 2, 20, 21, 22)], "user_id long, work_id long")
    seed, mass = spark.createDataFrame([(0,)], "seed long"), spark.createDataFrame([("w", 0.1)], "tag string, mass double")
    pool = lambda limit, **k: [(r["id"], r["source"]) for r in pools.candidate_pool(works, tags, reads, None, seed, limit, **k).orderBy("place").collect()]
    assert pool(16) == [(1, 0), (2, 0), (20, 1), (21, 1), (22, 1)]
    assert pool(8, mass=mass) == [(1, 0), (2, 0), (20, 1), (21, 1), (22, 1), (30, 2), (31, 2), (32, 2)]
    assert pool(4, mass=mass) == [(1, 0), (2, 0), (20, 1), (30, 2)]  # 2 is asked of the readers again and not replaced
    assert pool(1) == [(1, 0)]


def test_near_tags_of_mean_centroids(spark):
    """The centre is the mean of the seeds' means, not of all their tags; tags under a cosine of 0.25 aren't near."""
    tags = spark.createDataFrame([(0, "a", "x"), (1, "b", "x"), (1, "c", "x"), (1, "d", "x")], "work_id long, tag string, tag_type string")
    v = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.0, 1.0], "d": [0.0, 0.0], "p": [1.0, 1.0], "q": [1.0, -0.7], "r": [1.0, -0.1], "z": [0.0, 0.0]}
    vectors = spark.createDataFrame(list(v.items()), "tag string, v array<double>")
    got = [(r["tag"], round(r["w"], 4)) for r in pools.near_tags(tags, vectors, spark.createDataFrame([(0,), (1,)], "seed long")).orderBy(F.desc("w")).collect()]
    assert got == [("p", 1.0), ("r", 0.6332)]


def test_latent_needs_a_seed_with_factors(spark):
    f = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0])], "id long, features array<double>")
    got = {r["id"]: round(r["value"], 4) for r in pools.latent(f, spark.createDataFrame([(1,), (9,)], "seed long")).collect()}
    assert got == {1: 1.0, 2: 0.7071, 3: 0.0}
    assert pools.latent(f, spark.createDataFrame([(9,)], "seed long")).count() == 0


def test_voters_without_vectors(spark):
    v = spark.createDataFrame([(1, 1, 3.0), (1, 2, 4.0), (2, 1, 1.0), (3, 9, 1.0)], "owner long, tag long, weight double")
    voters = spark.createDataFrame([(1,), (2,), (3,), (4,)], "voter long")
    assert {r["voter"]: round(r["agree"], 6) for r in st.agreement_with(v, voters, 1).collect()} == {1: 1.0, 2: 0.6, 3: 0.0, 4: 0.0}
    assert {r["agree"] for r in st.agreement_with(v, voters, None).collect()} == {1.0}
    assert {r["agree"] for r in st.agreement_with(v, voters, 4).collect()} == {0.0, 1.0}

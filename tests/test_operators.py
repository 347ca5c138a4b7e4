"""Operators on small hand-made relations: boundaries, ties, nulls and skips."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import scoring as fn
from quillspark.operators import corpus as op
from quillspark.operators import events as ev
from quillspark.operators import learning as ml
from quillspark.operators import ranking as rk
from quillspark.operators import related as rel
from quillspark.operators import upkeep as up
from quillspark.plans import catalogue
from quillspark.sources import html as ht
from quillspark.sources.tables import ShapeError, assert_shape

WORKS = "id long, title string, authors string, word_count long, rating string, kudos long, hits long, bookmarks long, complete boolean, update_date date, language string"


@pytest.fixture(scope="module")
def works(spark):
    rows = [(1, "A", "X, Y (z)", 1000, "T", 10, 100, None, True, None, "English"), (2, "B", "x", None, None, None, None, 3, None, None, None), (3, "C", "Y", 5000, "G", 10, 50, 2, False, None, "french")]
    return spark.createDataFrame(rows, WORKS)


@pytest.fixture(scope="module")
def tags(spark):
    rows = [(1, "a", "name"), (1, "a", "type"), (1, "b", "name"), (2, "b", "name"), (2, "c", "name"), (3, "a", "name"), (3, "b", "name"), (3, "c", "name")]
    return spark.createDataFrame(rows, "work_id long, tag string, tag_type string")


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_shapes(works, tags):
    assert assert_shape(tags, "work_tags") is tags
    with pytest.raises(ShapeError):
        assert_shape(tags, "works")


def test_filter_nulls_and_contradiction(works):
    assert ids(op.filtered(works, words_min=0)) == [1, 2, 3] and ids(op.filtered(works, words_min=1)) == [1, 3]
    assert ids(op.filtered(works, complete=True)) == [1] and ids(op.filtered(works, complete=False)) == [3]
    assert ids(op.filtered(works, languages=("FRENCH",))) == [3]
    with pytest.raises(ValueError):
        op.filtered(works, words_min=2, words_max=1)


def test_row_and_work_frequencies_differ(tags):
    rows, works = ({r["tag"]: r["df"] for r in f(tags).collect()} for f in (op.row_frequency, op.doc_frequency))
    assert rows == {"a": 3, "b": 3, "c": 2} and works == {"a": 2, "b": 3, "c": 2}


def test_medians(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "x int")
    assert df.agg(op.upper_median("x").alias("m")).first()["m"] == 3
    assert df.agg(op.nearest_rank("x", 0.5).alias("m")).first()["m"] == 2
    assert df.limit(0).agg(op.upper_median("x").alias("m")).first()["m"] is None


def test_author_keys(works):
    heads = {r["author"]: (r["works"], r["name"]) for r in op.author_head(works).collect()}
    assert heads == {"x": (2, "X"), "y": (2, "Y (z)")}


def test_signals_skip_rather_than_score_zero(works, tags, spark):
    s = spark.createDataFrame([(1,)], "seed long")
    q = {r["id"]: r["v"] for r in works.select("id", fn.quality(F.col("kudos"), F.col("word_count")).alias("v")).collect()}
    assert q[2] is None and q[1] > 0
    assert rk.seed_agreement(works, tags, s).count() == 0  # one seed can't agree
    got = rk.compose(works, {"x": works.where("id = 1").select("id", F.lit(0.0).alias("value")), "y": works.where("id = 9").select("id", F.lit(1.0).alias("value"))}, {"x": 1.0, "y": 1.0})
    assert [(r["id"], r["score"], len(r["evidence"])) for r in got.collect()] == [(1, 0.0, 1)]
    assert rk.degraded(works, {"y": works.where("id = 9").select("id", F.lit(1.0).alias("value"))}).first()["signal"] == "y"


def test_signals_of_no_weight_are_not_run(works, spark):
    def trained():
        raise AssertionError("it has no weight")

    opinion = works.where("id = 1").select("id", F.lit(0.5).alias("value"))
    got = rk.compose(works, {"x": opinion, "y": works.where("id < 3").select("id", F.lit(1.0).alias("value")), "z": trained}, {"x": 1.0, "y": 0.0, "z": 0.0})
    assert [(r["id"], r["score"], [e["signal"] for e in r["evidence"]]) for r in got.collect()] == [(1, 0.5, ["x"])]
    assert rk.compose(works, {"x": lambda: opinion}, {"x": 2.0}).collect()[0]["score"] == 1.0
    assert rk.compose(works, {"z": trained}, {"z": 0.0}).collect() == []


def test_tunes():
    tune, unknown = rk.retuned({"quality": 2.0, "nope": 1.0})
    assert tune["quality"] == 2.0 and unknown == ["nope"]
    left = rk.renormalised(rk.DEFAULT_TUNE, {"collab"})
    assert abs(sum(left.values()) - sum(rk.DEFAULT_TUNE.values())) < 1e-9 and "collab" not in left


def test_mmr_spreads_and_bounds_groups(spark):
    rows = [(1, i, 10.0 - i, ["t"] if i < 3 else [f"u{i}"], "g" if i < 3 else f"h{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "request long, id long, score double, tags array<string>, grp string")
    order = [r["id"] for r in rk.mmr(df, 6, 0.5).orderBy("place").collect()]
    assert order[0] == 0 and set(order) == set(range(6)) and order.index(1) > 1
    assert len([i for i in ids(rk.mmr(df, 6, 0.5, per_group=1)) if i < 3]) == 1
    assert ids(rk.mmr(df, 6, 0.5, duplicate=0.9)) == [0, 3, 4, 5]


def test_decade_weight_is_the_loop(spark):
    def loop(v):
        d = 0
        while v > 1 and d < 4:
            v, d = v / 10, d + 1
        return (d + v - 1) / 4

    values = [1, 2, 9, 10, 11, 100, 999, 1000, 12345, 5_000_000]
    got = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", fn.decade_weight(F.col("v")).alias("w")).collect()
    assert all(abs(r["w"] - loop(r["v"])) < 1e-9 for r in got)


def test_walk_keeps_mass_and_leaves_seeds_out(spark, tags):
    edges = op.symmetric(op.tag_pairs(tags))
    mass = {r["tag"]: r["mass"] for r in rel.personal_walk(edges, spark.createDataFrame([("a",)], "tag string")).collect()}
    assert set(mass) == {"b", "c"} and 0 < sum(mass.values()) < 1 and mass["b"] > mass["c"]


def test_frontier_depths(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (3, 4)], "src long, dst long")
    got = {r["node"]: r["depth"] for r in ht.frontier(spark.createDataFrame([(1,)], "node long"), links, 3).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}


def test_pages(spark):
    page = '<html><title> T &amp; t </title><script>x<y</script><a href="/a/b#f">A</a> <a href="c">B</a><a href="https://o.org/">O</a><a href="mailto:x">M</a><a rel="next" href="/p?2">n</a>&lt;z&gt;</html>'
    df = spark.createDataFrame([(1, "https://h.org/d/e", page), (2, "https://h.org/", None)], "page_id long, url string, html string")
    assert ids(ht.same_host_links(df, "page_id", "url", "html"), "link") == ["https://h.org/a/b", "https://h.org/d/c", "https://h.org/p?2"]
    r = df.select("page_id", ht.stripped(F.col("html")).alias("t"), ht.next_page(F.col("html")).alias("n")).orderBy("page_id").collect()
    assert r[0]["t"].startswith("T & t A") and r[0]["t"].endswith("<z>") and "x<y" not in r[0]["t"]
    assert r[0]["n"] == "/p?2" and r[1]["t"] is None
    items = df.where("page_id = 1").select(F.size(ht.listing(F.lit('x<li id="w1">a<li id="w2">b'), '<li id="')).alias("n")).first()["n"]
    assert items == 2


def test_snapshot_shards_verify(spark):
    df = spark.createDataFrame([(str(i), i) for i in range(50)], "reader string, n int")
    s = ht.shard_table(df, "reader", 4)
    manifest = s.select("shard", "digest")
    assert ht.verified(s.select("shard", "body"), manifest).count() == 0
    assert ht.verified(s.select("shard", F.concat("body", F.lit(" ")).alias("body")), manifest).count() == s.count()


def test_events_on_empty_logs(spark):
    log = spark.createDataFrame([], "owner long, item long, ts timestamp, key long, stance int")
    assert ev.visits(log, "owner", "ts", "key", 30).count() == 0
    assert ev.impressions_deduped(log, "owner", "item", "ts", "key", 1).count() == 0
    assert ev.last_touch(log, log, "owner", "item", "ts", "key", 1).count() == 0


def test_glicko_period_counts_each_game_once(spark):
    g = spark.createDataFrame([(1, 2, "a"), (1, 3, "draw")], "a long, b long, winner string")
    side = ev.sides(g)
    assert {(r["entity"], r["wins"], r["losses"], r["draws"]) for r in ev.tally(side).collect()} == {(1, 1, 0, 1), (2, 0, 1, 0), (3, 0, 0, 1)}
    out = {r["entity"]: r for r in ev.glicko_period(side, spark.createDataFrame([(9, 1500.0, 60.0, 0.06)], "entity long, mu double, phi double, sigma double")).collect()}
    assert out[1]["mu"] > 1500 > out[2]["mu"] and out[9]["phi"] > 60 and out[9]["games"] == 0


def test_upsert_keeps_known_bookmarks(works):
    new = works.where("id = 3").withColumn("bookmarks", F.lit(None).cast("long")).withColumn("kudos", F.lit(99).cast("long"))
    r = {x["id"]: x for x in up.upsert_works(works, new).collect()}
    assert r[3]["bookmarks"] == 2 and r[3]["kudos"] == 99 and r[1]["kudos"] == 10 and len(r) == 3


def test_adjusted_rand_extremes(spark):
    df = spark.createDataFrame([(i % 3, i % 3, i) for i in range(30)], "a int, b int, c int")
    assert ml.adjusted_rand(df, "a", "b").first()["ari"] == 1.0
    assert abs(ml.adjusted_rand(df, "a", "c").first()["ari"]) < 1e-9


def test_spectral_block_is_orthonormal(spark):
    rows = [(f"n{i}", f"n{(i + k) % 12}", 1) for i in range(12) for k in (1, 2, 5)]
    v = [r["v"] for r in ml.spectral_embedding(spark.createDataFrame(rows, "src string, dst string, co int"), 3, 3).collect()]
    for i in range(3):
        for j in range(3):
            assert abs(sum(x[i] * x[j] for x in v) - (i == j)) < 1e-6


def test_fnv_known_value():
    assert up.fnv1a64(pd.Series(["", "a"])).tolist() == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C]


def test_fuzzy_match_meets_spellings_once(spark):
    """3,000 works of one title and author, 3,000 entries near it, one without an author: nine million pairs, never made."""
    works = spark.range(10, 3010).select("id", F.lit("hot ring").alias("title"), F.lit("Ann").alias("authors"))
    entries = spark.range(3000).select(F.col("id").alias("entry"), F.when(F.col("id") % 2 == 0, "Hot Rings").otherwise("hot ring").alias("title"), F.when(F.col("id") == 1, None).otherwise(F.lit("ann")).alias("author"))
    out = op.fuzzy_match(entries, works)
    made = out.groupBy("method", "id").count().collect()
    assert {(r["method"], r["id"]): r["count"] for r in made} == {(2, 10): 1500, (1, 10): 1499, (3, 10): 1}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("min(id") >= 2


@pytest.mark.parametrize("literal", [False, True])
def test_agreement_meets_blocks(spark, literal):
    """Owners in blocks of three: nulls, no number and owners without shared tags, against sums pair by pair; no join by tag."""
    rows = [(f"o{o:02}", t, None if (o + t) % 9 == 0 else float((o * 7 + t * 3) % 11 - 5)) for o in range(12) for t in range(9) if (o * t) % 4 or o % 3]
    rows += [("odd", t, float("nan") if t == 1 else 1.0) for t in range(2, 7)] + [("odd", 1, float("nan")), ("far", 99, 1.0)]
    out = up.agreement(spark.createDataFrame(rows, "owner string, tag long, weight double"), 3, literal, block=3)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    by = {}
    for o, t, w in rows:
        by.setdefault(o, {})[t] = w
    want = {}
    for x in by:
        for y in by:
            both = sorted(by[x].keys() & by[y].keys())
            if x < y and len(both) >= 3:
                dots = [by[x][t] * by[y][t] for t in both if by[x][t] is not None and by[y][t] is not None]
                sx, sy = (sum(by[o][t] ** 2 for t in (both if literal else by[o]) if by[o][t] is not None) for o in (x, y))
                norm = (sx * sy) ** 0.5
                want[x, y] = len(both), None if norm and not dots else round(sum(dots) / norm, 9) + 0.0 if norm else 0.0
    got = {(r["x"], r["y"]): (r["shared"], r["agree"] if r["agree"] is None else round(r["agree"], 9) + 0.0) for r in out.collect()}
    assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()} and want


@pytest.mark.parametrize("literal", [False, True])
def test_agreement_copies_parts_not_rows(spark, literal):
    """80 owners in blocks of two, so parts of several blocks: every pair is met once, and rows aren't copied for every block."""
    rows = [(o, t, float((o * 7 + t * 3) % 11 - 5)) for o in range(80) for t in range(12)]
    out = up.agreement(spark.createDataFrame(rows, "owner long, tag long, weight double"), 3, literal, block=2, digits=6)
    w = np.zeros((80, 12))
    for o, t, x in rows:
        w[o, t] = x
    cos = (w @ w.T) / np.sqrt((w * w).sum(1)[:, None] * (w * w).sum(1)[None, :])
    got = {(r["x"], r["y"]): (r["shared"], r["agree"]) for r in out.collect()}
    assert got.keys() == {(x, y) for x in range(80) for y in range(x + 1, 80)}
    assert all(s == 12 and abs(a - cos[x, y]) < 1e-6 for (x, y), (s, a) in got.items())
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = lambda name: [k for k, line in enumerate(plan) if name in line]
    assert len(at("FlatMapGroupsInArrow")) == 2 and at("FlatMapGroupsInArrow")[0] < at("Generate explode")[0] < at("FlatMapGroupsInArrow")[1]


def test_rounding_as_spark(spark):
    xs = [0.5047875, -0.5047875, 0.0000005, -0.0000005, 1e-9, -1e-9, -0.0, 0.1234565, 2.5e-6, 123456.7890125, 1e15 + 0.5, 1e300, float("nan"), float("inf"), -1.0, *(k / 2**7 / 1e4 for k in range(-300, 300))]
    want = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(F.round("x", 6)).collect()]
    assert list(map(repr, up._rounded(np.array(xs), 6).tolist())) == list(map(repr, want))


def pairwise(vectors, query, k, least):
    """nearest with a row for every pair."""
    met = vectors.join(query, F.size("v") == F.size("qv")).where("id <> query_id").withColumn("sim", F.round(fn.cosine(F.col("v"), F.col("qv")), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return met.where(F.col("sim") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "sim", "rank")


@pytest.mark.parametrize("least", [0.1, -1.0])
def test_nearest_meets_blocks(spark, least):
    """Copies, near copies, ties of scaled vectors, zeros, nulls, NaN, infinities, tiny norms, other widths and null ids."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 6)).astype(np.float32).tolist()
    odd = [None, [], [0.0] * 6, [None, *[1.0] * 5], [float("nan")] * 6, [float("inf"), *[1.0] * 5], [1e-38] * 6, [1.0, 2.0], [2.0, 1.0], [-1.0, 0.5]]
    rows = [*base, *([base[0]] * 40), *([2 * x for x in base[1]] for _ in range(15)), *([x + 1e-7 for x in base[2]] for _ in range(15)), *odd * 2]
    v = spark.createDataFrame([*enumerate(rows), (None, base[3])], "id long, v array<float>").repartition(3)
    q = v.where("id % 7 = 0 or id >= 370").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    got, want = (sorted(map(repr, f(v, q, 5, least).collect())) for f in (op.nearest, pairwise))
    assert got == want and len(want) > 300
    assert op.nearest(v, q.where("false"), 5, least).count() == 0


def test_nearest_makes_no_row_for_a_pair(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    plan = op.nearest(v, v.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), 10, 0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_nearest_vectors_rounds_as_its_sql(spark, tmp_path):
    """0.5047875 is 0.504787 as a double: its sixth place is rounded down."""
    near = [0.5047875, (1 - 0.5047875**2) ** 0.5]
    spark.createDataFrame([(0, [1.0, 0.0], 0), (1, near, 0)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sql = catalogue.oracle_sql()["nearest_vectors"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    sql = sql.replace(f"'{tmp_path}/embeddings.parquet/*.parquet', q", f"'{tmp_path}/embeddings.parquet/*.parquet' AS embeddings, q")
    got = catalogue.queries()["nearest_vectors"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == duckdb.connect().sql(sql).fetchall() == [(0, 1, 0.504787, 1)]

"""Rating periods, paired comparisons, credit, snapshots and pages on hand-made rows and against brute force."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import stats
from quillspark.operators import assess as sm
from quillspark.operators import events as ev
from quillspark.sources import html as ht

JUDGED = "kind string, at timestamp, winner long, loser long, score double, agreement double"
RATINGS = "kind string, entity long, mu double, phi double, sigma double, games long, wins long, losses long, draws long"
LAST = "kind string, since timestamp"


def day(n):
    return datetime.datetime(2024, 1, n)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_period_as_in_the_worked_example(spark):
    side = spark.createDataFrame([(1, 2, 1.0), (1, 3, 0.0), (1, 4, 0.0)], "entity long, opponent long, score double")
    known = spark.createDataFrame([(1, 1500.0, 200.0, 0.06), (2, 1400.0, 30.0, 0.06), (3, 1550.0, 100.0, 0.06), (4, 1700.0, 300.0, 0.06), (5, 1500.0, 50.0, 0.06)], "entity long, mu double, phi double, sigma double")
    got = {r["entity"]: r for r in ev.glicko_period(side, known).collect()}
    assert math.isclose(got[1]["mu"], 1464.06, abs_tol=0.05) and math.isclose(got[1]["phi"], 151.52, abs_tol=0.05) and got[1]["games"] == 3
    assert got[5]["mu"] == 1500 and got[5]["phi"] > 50 and got[5]["games"] == 0


def test_a_batch_of_kinds(spark):
    judged = spark.createDataFrame(
        [
            ("a", day(1), 1, 2, 1.0, 1.0),  # before the last run
            ("a", day(3), 1, 2, 1.0, 1.0),
            ("a", day(3), 3, 1, 0.5, 0.5),
            ("a", day(4), 4, 5, 1.0, 0.1),  # too little influence
            ("b", day(1), 1, 2, 1.0, -1.0),  # nothing that counts: no period
        ],
        JUDGED,
    )
    before = spark.createDataFrame([("a", 1, 1600.0, 100.0, 0.06, 2, 1, 1, 0), ("a", 4, 1550.0, 90.0, 0.05, 7, 7, 0, 0)], RATINGS)
    last = spark.createDataFrame([("a", day(2))], LAST)
    got = {(r["kind"], r["entity"]): r for r in sm.rating_batch(judged, before, last).collect()}
    assert set(got) == {("a", i) for i in (1, 2, 3, 4, 5)}
    tallies = {k[1]: (r["games"], r["wins"], r["losses"], r["draws"]) for k, r in got.items()}
    assert tallies == {1: (3, 2, 1, 0), 2: (1, 0, 1, 0), 3: (1, 0, 0, 1), 4: (7, 7, 0, 0), 5: (0, 0, 0, 0)}
    want = stats.glicko(1600, 100, 0.06, [(1500, 350, 1.0, 1.0), (1500, 350, 0.5, 0.25)])
    assert all(math.isclose(g, w, rel_tol=1e-9) for g, w in zip((got["a", 1]["mu"], got["a", 1]["phi"], got["a", 1]["sigma"]), want))
    assert (got["a", 4]["mu"], got["a", 4]["phi"]) == (1550, 90) and (got["a", 5]["mu"], got["a", 5]["phi"]) == (1500, 350)
    twice = {r["entity"]: r["mu"] for r in sm.rating_batch(judged, before, last, as_reference=True).collect()}
    assert math.isclose(twice[2], stats.glicko(1500, 350, 0.06, [(1600, 100, 0.0, 1.0)] * 2)[0], rel_tol=1e-9)
    assert rows(sm.rating_batch(judged.limit(0), before, last)) == []


def test_draws_are_two_half_duels(spark):
    judged = spark.createDataFrame([("a", 1, 2, 1.0, 1.0), ("a", 1, 2, 0.5, 1.0), ("a", 1, 2, 0.0, 0.5), ("a", 1, 2, 1.0, 0.0), ("a", 1, 2, 1.0, None)], "kind string, winner long, loser long, score double, weight double")
    assert rows(sm.duels(judged)) == [("a", 1, 2, 0.5), ("a", 1, 2, 1.0), ("a", 2, 1, 0.5), ("a", 2, 1, 0.5)]


def test_paired_comparison_by_bootstrap(spark):
    rng = random.Random(3)
    base = [(i, rng.random(), rng.random()) for i in range(300)]
    arm = [(i, a + 0.2 + 0.1 * rng.random(), rng.random()) for i, a, _ in base] + [(999, 0.0, 0.0)]
    make = lambda r, n: spark.createDataFrame(r, "id long, up double, same double").repartition(n)
    got = {r["metric"]: r for r in sm.paired(make(base, 3), make(arm, 5), "id", ["up", "same"]).collect()}
    assert got["up"]["verdict"] == "BETTER" and got["same"]["verdict"] == "NO VERDICT" and got["up"]["n"] == 300
    diffs = [b[1] - a[1] for a, b in zip(base, arm)]
    mean, low, high = stats.bootstrap(__import__("numpy").array(diffs))
    assert math.isclose(got["up"]["diff"], mean, rel_tol=1e-9) and abs(got["up"]["low"] - low) < 0.005 and abs(got["up"]["high"] - high) < 0.005
    again = {r["metric"]: r for r in sm.paired(make(base, 7), make(arm, 2), "id", ["up", "same"]).collect()}
    assert math.isclose(again["up"]["low"], got["up"]["low"], rel_tol=1e-9)
    assert sm.paired(make(arm, 1), make(base, 1), "id", ["up"]).first()["verdict"] == "WORSE"
    assert sm.paired(make(base[:3], 1), make(arm[9:], 1), "id", ["up"]).collect() == []


def test_validation_needs_more_than_popularity(spark):
    rated = [(float(i), i % 10 + 1, i % 10 * 1.0, 7) for i in range(200)]
    df = spark.createDataFrame(rated, "id double, rating int, predicted double, kudos int")
    assert sm.validation(df.withColumn("kudos", F.hash("id"))).first()["verdict"] == "strong"
    assert sm.validation(df.withColumn("predicted", -F.col("predicted")).withColumn("kudos", F.hash("id"))).first()["verdict"] == "negative"
    assert sm.validation(df.withColumn("kudos", F.col("rating"))).first()["verdict"] == "no better"


def test_groups_too_small_are_left_out(spark):
    placed = spark.createDataFrame([(1, 1), (2, 0), (3, 4)], "work long, rank int")
    groups = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (3, "y"), (1, "")], "work long, name string")
    assert rows(sm.by_group(placed, groups, "tag", 2)) == [("tag", "x", 2, 1, 0.5)]


def credited(log):
    """Every click takes the latest open list of its keys."""
    stacks, out = {}, []
    for owner, _, key, click in sorted(log, key=lambda r: (r[1], r[2])):
        s = stacks.setdefault(owner, [])
        if not click:
            s.append(key)
        elif s:
            out.append((key, s.pop()))
    return sorted(out, key=str)


def test_credit_by_seed_against_stacks(spark):
    rng = random.Random(5)
    log = [(rng.randrange(6), rng.randrange(60), k, rng.random() < 0.55) for k in range(400)]
    df = spark.createDataFrame(log, "owner long, at long, key long, click boolean")
    assert rows(sm.seed_credit(df, ["owner"], "at", "key")) == credited(log)
    assert rows(sm.seed_credit(df.limit(0), ["owner"], "at", "key")) == []


def test_snapshots_to_make_and_to_remove(spark):
    m = spark.createDataFrame([(0, True, None), (1, False, 0), (2, True, None), (3, True, 2), (4, False, None), (18, True, None), (19, False, 2)], "version long, full boolean, base long")
    got = {r["version"]: (r["full"], r["base"], r["reason"]) for r in sm.snapshot_plan(m).collect()}
    assert got[1] == (False, 0, "delta") and got[2][2] == "no delta on a delta" and got[4][2] == "full with a base" and got[5][2] == "delta without a base"
    assert got[19] == (False, 18, "delta") and got[20] == (True, None, "on the interval")
    assert rows(sm.prunable(m, 2)) == [(0,), (1,), (3,), (4,)]
    with pytest.raises(ValueError):
        sm.prunable(m, 0)


def test_pages_of_bookmarks_and_universes(spark):
    page = """<h2>List of Bookmarks</h2><li id="bookmark_5" class="bookmark blurb group work-34"><a href="/works/34">A &lt; B</a><p class="status" title="1,016 Bookmarks"></p><p class="datetime"> 04 Mar 2024 </p></li>
    <li id="bookmark_6" class="bookmark blurb group"><a href="/series/9">no work</a></li><li id="bookmark_7" class="bookmark blurb work-35"></li>"""
    got = spark.createDataFrame([(page,), ("<p>nothing</p>",), ("",), (None,)], "h string").select(ht.bookmarks(F.col("h")).alias("b")).collect()
    assert [tuple(x) for x in got[0]["b"]] == [(5, 34, "A < B", "04 Mar 2024", 1016), (7, 35, "", "", None)]
    assert [r["b"] for r in got[1:]] == [[], [], None]
    links = '<a class="tag" href="/tags/X%20&#39;s%zz/works">X&#39;s</a> (1,234)<a href="/tags/Y+Z/works"> Y+Z </a>\n(5)<a href="/tags/q/works"></a> (3)<a href="/users/q">q</a> (3)'
    got = spark.createDataFrame([(links,), (None,)], "h string").select(ht.universe_links(F.col("h")).alias("u")).collect()
    assert [tuple(x) for x in got[0]["u"]] == [("X's", "X%20's%zz", 1234), ("Y+Z", "Y+Z", 5)] and got[1]["u"] is None


def test_popular_lists_skip_what_is_known(spark):
    """Readers of all popular works get the next ones: against plain lists."""
    from quillspark.plans.experiments import holdout, popularity_lists
    from quillspark.sources.tables import Roles

    rng = random.Random(9)
    works = [(i, rng.randrange(12)) for i in range(80)]
    order = [i for i, _ in sorted(works, key=lambda w: (-w[1], w[0]))]
    reads = [(1, i) for i in order[:60]] + [(2, i) for i in order[5:75:3]] + [(3, i) for i in order] + [(4, order[0])]
    w = spark.createDataFrame(works, "id long, kudos long")
    reads_df = spark.createDataFrame(reads, "user_id long, work_id long")
    held = {(r["user_id"], r["work_id"]): r["held_out"] for r in holdout(reads_df).collect()}
    hit, _ = popularity_lists(Roles(w, reads_df, reads_df), 10)
    got = {}
    for r in hit.collect():
        got.setdefault(r["user_id"], {})[r["pos"]] = r["hit"]
    for u in (1, 2, 3):
        want = [held.get((u, i), False) for i in order if held.get((u, i)) is not False][:10]
        assert [got[u][p] for p in sorted(got[u])] == want and sorted(got[u]) == list(range(1, len(want) + 1))
    assert 4 not in got


def test_list_diversity_without_pairs(spark):
    """Small, large, equal and empty sets against every pair; small sets alone are never joined."""
    from itertools import combinations

    from quillspark.operators import assess

    sets = {i: sorted({f"t{(i * k) % 7}" for k in range(1 + i % 4)} | ({f"u{k}" for k in range(i % 3 + 3)} if i % 5 == 0 else set())) for i in range(40)} | {40: [], 41: [], 99: ["z"]}
    listed = spark.createDataFrame([(1 if i == 99 else 0, i, t) for i, t in sets.items()], "lst long, id long, tags array<string>")
    pairs = list(combinations([set(t) for i, t in sets.items() if i != 99], 2))
    want = sum(len(a & b) / len(a | b) if a | b else 0 for a, b in pairs) / len(pairs)
    for most in (3, 8):
        (row,) = assess.list_diversity(listed, most).collect()
        assert row["lst"] == 0 and row["pairs"] == len(pairs) and abs(row["mean_jaccard"] - want) < 1e-12

"""Shelves, harvests, authors, themes, divided families and fingerprints on hand-made rows and by their invariants."""

import math

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import shelves as sh

TAGS = "work_id long, tag string, tag_type string"
WORKS = "id long, title string, authors string, kudos long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def jaccard(a, b):
    return len(a & b) / len(a | b)


def greedy(items, n, lam, cut, top=None):
    """items: (id, score, tags); the best of what is left, less its likeness to what is chosen."""
    top, out, left = top or max(s for _, s, _ in items), [], sorted(items)
    while left and len(out) < n:
        worth = lambda x: lam * x[1] / top - (1 - lam) * max((jaccard(x[2], y[2]) for y in out), default=0.0)  # noqa: B023, E731
        best = min(left, key=lambda x: (-worth(x), x[0]))
        left.remove(best)
        if max((jaccard(best[2], y[2]) for y in out), default=0.0) < cut:
            out.append(best)
    return [i for i, _, _ in out]


def corpus(spark):
    sets = {i: {"X" if i <= 8 else "Y", f"t{i % 3}", f"u{i % 4}"} | ({"x (anime)"} if i <= 6 else set()) for i in range(1, 15)}
    tags = spark.createDataFrame([(i, t, "tag") for i, ts in sets.items() for t in sorted(ts)], TAGS)
    works = spark.createDataFrame([(i, f"w{i}", f"a{i % 5}", 10 * i) for i in sets], WORKS)
    return sets, tags, works


def test_a_shelf_has_one_spelling_of_a_universe(spark):
    sets, tags, works = corpus(spark)
    names = spark.createDataFrame([("x", 100), ("X (Anime)", 90), ("Y", 80), ("none", 5)], "name string, works long")
    read = spark.createDataFrame([(1,), (2,), (9,)], "work_id long")
    members, scores = sh.universe_works(tags, names), sh.taste_scores(read, tags)
    ranked = sh.ranked_universes(members, scores, names, read, 10)
    got = {r["universe"]: r for r in ranked.collect()}
    assert {u: (r["n"], r["bookmarked"], r["catalogue"]) for u, r in got.items()} == {"x": (8, 2, 100), "x (anime)": (6, 2, 90), "y": (6, 1, 80)}
    assert set(sh.without_variants(ranked, members)) == {"x", "y"}
    shelf = sh.build_shelf(works, tags, names, read, universes=5, per=4).collect()
    s = {r["work_id"]: r["s"] for r in scores.collect()}
    for u in ("x", "y"):
        mine = sorted((r for r in shelf if r["universe"] == u), key=lambda r: r["place"])
        pool = sorted((i for i in sets if u.upper() in sets[i]), key=lambda i: (-round(s[i] * (1 + 0.25 * math.log1p(10 * i) / 8), 9), i))[:8]
        assert [r["id"] for r in mine] == greedy([(i, s[i], sets[i]) for i in pool], 4, 0.75, 0.9, s[pool[0]])
    assert sh.build_shelf(works, tags, names, read.limit(0), universes=5, per=4).collect() == []


def test_a_harvest_takes_what_is_not_held(spark):
    sets, _, _ = corpus(spark)
    found = spark.createDataFrame([("p" if i % 2 else "q", i, float(i), sorted(t)) for i, t in sets.items()], "universe string, id long, score double, tags array<string>")
    held = spark.createDataFrame([(13,), (13,)], "id long")
    quotas = spark.createDataFrame([("p", 3), ("q", 1), ("r", 4)], "universe string, quota long")
    got = {}
    for u, i, place in rows(sh.harvest_fill(found, held, quotas)):
        got.setdefault(u, {})[place] = i
    want = {u: greedy([(i, float(i), t) for i, t in sets.items() if i % 2 == odd and i != 13], n, 0.75, 1.01) for u, odd, n in (("p", 1, 3), ("q", 0, 1))}
    assert {u: [g[k] for k in sorted(g)] for u, g in got.items()} == want
    assert rows(sh.harvest_fill(found, held, quotas.limit(0))) == []


def test_authors_by_rare_tags(spark):
    tags = [(i, "all") for i in range(1, 9)] + [(1, "r"), (2, "r"), (3, "r"), (1, "s"), (4, "s"), (5, "s"), (1, "own")]
    tags = spark.createDataFrame([(i, t, "k") for i, t in tags], TAGS)
    authors = {1: "Me", 2: "Ann, Bob (bobby)", 3: "ann", 4: "Bob", 5: "Cy", 6: "Di", 7: "", 8: None}
    works = spark.createDataFrame([(i, "t", a, 1) for i, a in authors.items()], WORKS)
    got = [(r["author"], r["works"], r["score"]) for r in sh.authors_like(works, tags, "me").collect()]
    assert [g[:2] for g in got] == [("Bob", 2), ("Ann", 2), ("Cy", 1)] and math.isclose(got[0][2], 1.0, abs_tol=1e-9) and math.isclose(got[1][2], math.sqrt(0.5), abs_tol=1e-8)
    assert sh.authors_like(works, tags, "nobody").collect() == []


def test_themes_count_their_children(spark):
    families = spark.createDataFrame([(1, None, "one", 9), (2, 1, "below", 3), (3, None, "three", 0)], "id long, parent long, label string, size long")
    members = spark.createDataFrame([(10, 2), (11, 1), (11, 2), (12, 1), (99, 1), (13, 2)], "work long, family long")
    works = spark.createDataFrame([(i, f"w{i}", "", 0) for i in (10, 11, 12, 13)], WORKS)
    got = {r["id"]: (r["label"], r["size"], [tuple(s) for s in r["sample"]]) for r in sh.themes(families, members, works).collect()}
    assert got == {1: ("one", 9, [(10, "w10"), (11, "w11"), (12, "w12")]), 3: ("three", 0, [])}
    assert rows(sh.theme_works(families, members, works, 2, 9)) == [(10, "w10"), (11, "w11"), (13, "w13")] and rows(sh.theme_works(families, members, works, 3, 9)) == []


def test_families_are_cut_in_parts_of_like_size(spark):
    rng = np.random.default_rng(3)
    data = [(f, i, i % 5, (rng.normal(size=4) + (5 if i % 9 == 0 else 0)).tolist()) for f, n in ((1, 41), (2, 3), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(data, "family long, id long, support long, v array<double>")
    got = rows(sh.divide(df, 4).select("family", "sub", "id"))
    sizes = {}
    for f, s, i in got:
        sizes.setdefault(f, {}).setdefault(s, set()).add(i)
    assert set().union(*sizes[1].values()) <= set(range(41)) and all(2 <= len(m) <= 16 for m in sizes[1].values()) and sum(map(len, sizes[1].values())) >= 38
    assert 3 not in sizes and got == rows(sh.divide(df.repartition(5), 4).select("family", "sub", "id"))


def test_drift_of_vectors(spark):
    schema = "id long, v array<double>"
    old = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, [3.0, 4.0])], schema)
    f = sh.fingerprint(old).first()
    assert (f["rows"], f["width"], f["mean_norm"], f["centroid"]) == (4, 2, 2.0, [1.0, 1.5]) and sh.fingerprint(old.limit(0)).collect() == []
    same = sh.drift_between(old, old).first()
    assert (same["verdict"], same["sampled"], same["empty"]) == ("reproduced", 3, 1) and math.isclose(same["sample_cosine"], 1) and math.isclose(same["centroid_cosine"], 1)
    word = lambda new: sh.drift_between(old, new).first()["verdict"]
    assert word(old.withColumn("v", F.transform("v", lambda x: x * 2))) == "rescaled"
    assert word(old.withColumn("v", F.reverse("v"))) == "moved"
    assert word(old.withColumn("v", F.slice("v", 1, 1))) == "width changed"
    assert word(old.withColumn("id", F.col("id") + 100)) == "nothing shared"

"""Sides that grow with the works are never broadcast on the size of their compressed file."""

import pytest

from quillspark.operators import ranking as rk
from quillspark.plans import catalogue
from quillspark.plans import ranking as plans
from quillspark.sources.tables import Roles, catalog


def broadcasts(df):
    """Output columns of what is broadcast before it runs; a top-k (seeds) is bounded and left out."""
    found = []

    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "BroadcastExchangeExec":
            below = p.child()
            while below.getClass().getSimpleName() in ("ProjectExec", "FilterExec"):
                below = below.child()
            if below.getClass().getSimpleName() != "TakeOrderedAndProjectExec":
                found.append(p.output().mkString(","))
        kids = [p.initialPlan()] if kind == "AdaptiveSparkPlanExec" else [p.children().apply(i) for i in range(p.children().size())]
        for x in kids:
            walk(x)

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.mark.parametrize("name", ["signal_tag_npmi", "shelf_universes", "shelf_pool", "signal_embedding", "shelf_build"])
def test_works_are_not_broadcast(name, spark, sf):
    sides = broadcasts(catalogue.queries()[name](spark, sf))
    assert not [s for s in sides if "work_id" in s]


def test_recommend_trains_nothing_without_a_weight(spark, sf, monkeypatch):
    def trained(*a, **k):
        raise AssertionError("the latent signal has no weight")

    monkeypatch.setattr(plans.learning, "als_factors", trained)
    assert [r["place"] for r in catalogue.queries()["recommend"](spark, sf).orderBy("place").collect()] == list(range(1, 21))


def test_recommend_walks(spark, sf, monkeypatch):
    """The walk is a source of the pool and a signal."""
    seen = {}
    pooled, composed = plans.pools.candidate_pool, plans.rk.compose
    monkeypatch.setattr(plans.pools, "candidate_pool", lambda *a, **k: seen.update(mass=k.get("mass")) or pooled(*a, **k))
    monkeypatch.setattr(plans.rk, "compose", lambda c, signals, tune: seen.update(walk=signals.get("walk")) or composed(c, signals, tune))
    catalogue.queries()["recommend"](spark, sf)
    assert seen["mass"].count() > 0 and seen["walk"].count() > 0


def test_signals_of_some_works_are_those_of_all(spark, sf):
    """Signals made for a part of the works, seeds among them, are what signals for all works say of these."""
    r = catalog(spark, sf)
    first = plans.seeds(r.works)
    ids = r.works.where("id % 3 = 0").select("id").union(first).distinct()
    own = Roles(r.works.join(ids, "id", "left_semi"), r.work_tags.join(ids.withColumnRenamed("id", "work_id"), "work_id", "left_semi"), r.interactions)
    vectors = plans.tag_vectors(spark, sf, r.work_tags)
    some, every = (rk.compose(ids, plans.all_signals(r, vectors, first, of), rk.DEFAULT_TUNE).collect() for of in (own, r))
    flat = lambda rows: {x["id"]: [round(x["score"], 9), sorted((e["signal"], round(e["value"], 9)) for e in x["evidence"])] for x in rows}
    assert flat(some) == flat(every) and len(some) == ids.count()


def test_mean_vectors_of_odd_shapes(spark):
    """Vectors with nulls or of other widths: each place is the mean of what stands there, as by one row a place."""
    tags = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (2, "b", "x"), (2, "c", "x"), (3, "d", "x"), (4, "e", "x")], "work_id long, tag string, tag_type string")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 6.0]), ("c", [None, 1.0, 5.0]), ("d", []), ("e", [None])], "tag string, v array<float>")
    got = {r["work_id"]: r["v"] for r in rk.mean_vectors(tags, vectors).collect()}
    assert got == {1: [2.0, 4.0], 2: [3.0, 3.5, 5.0], 4: [None]}

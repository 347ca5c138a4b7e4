"""Queries for ranking signals, composition, corpus-query modes and related entities, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import scoring as fn
from quillspark.operators import corpus as op
from quillspark.operators import learning, pools
from quillspark.operators import ranking as rk
from quillspark.operators import related as rel
from quillspark.plans.corpus import AS_OF, TERMS, seeds
from quillspark.plans.registry import SQL, query
from quillspark.sources.staging import staged
from quillspark.sources.tables import Roles, catalog, table

R6 = lambda c: F.round(c, 6).alias(c)


def value(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("value", 6).alias("value"))


NBR = """, nb AS (SELECT src, dst, co, s.df AS fs, d.df AS fd, n, round(ln(co * n / (s.df * d.df)), 9) AS pmi,
    round(CASE WHEN co / n >= 1 THEN 1.0 ELSE greatest(-1.0, least(1.0, ln(co * n / (s.df * d.df)) / -ln(co / n))) END, 9) AS npmi FROM sym JOIN df s ON s.tag = src JOIN df d ON d.tag = dst, total),
    st AS (SELECT DISTINCT tag FROM carried JOIN seeds ON work_id = seed)"""
IDF = """, idf AS (SELECT tag, df, n, CASE WHEN df >= n THEN 0.0 ELSE ln(n / df) END AS idf FROM df, total)"""
ALL = "works work_tags carried df total sym seeds interactions reads"


@query(
    """, s AS (SELECT work_id AS seed, tag FROM carried JOIN seeds ON work_id = seed), z AS (SELECT work_id, count(*) AS n FROM carried GROUP BY 1),
    b AS (SELECT c.work_id, s.seed, count(*) AS c FROM carried c JOIN s USING (tag) WHERE c.work_id <> s.seed GROUP BY 1, 2)
    SELECT b.work_id AS id, round(max(c / (x.n + y.n - c)), 6) AS value FROM b JOIN z x ON x.work_id = b.work_id JOIN z y ON y.work_id = b.seed GROUP BY 1""",
    "carried seeds",
)
def signal_tag_overlap(spark, d):
    r = catalog(spark, d)
    return value(rk.tag_overlap(r.work_tags, seeds(r.works)))


@query(
    NBR + """, v AS (SELECT dst AS tag, sum(pmi) AS vote FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY pmi DESC, dst) AS rn FROM nb WHERE pmi > 0 AND src IN (SELECT tag FROM st)) WHERE rn <= 24 GROUP BY 1),
    p AS (SELECT work_id AS id, sum(vote) / sqrt(count(*)) AS x FROM carried LEFT JOIN v USING (tag) GROUP BY 1) SELECT id, round(x / (x + 100), 6) AS value FROM p WHERE x IS NOT NULL""",
    ALL,
)
def signal_neighbourhood(spark, d):
    r = catalog(spark, d)
    return value(rk.neighbourhood_pmi(r.works, r.work_tags, seeds(r.works)))


@query(
    NBR + """, v AS (SELECT dst AS tag, max(npmi) AS vote FROM nb WHERE npmi > 0 AND src IN (SELECT tag FROM st) GROUP BY 1),
    p AS (SELECT work_id AS id, sum(vote) AS s, count(*) AS n FROM carried LEFT JOIN v USING (tag) GROUP BY 1) SELECT id, round(s / n, 6) AS value FROM p WHERE s IS NOT NULL""",
    ALL,
)
def signal_neighbourhood_npmi(spark, d):
    r = catalog(spark, d)
    return value(rk.neighbourhood_npmi(r.works, r.work_tags, seeds(r.works)))


@query("SELECT id, round(least(1.0, ln(1 + kudos / (word_count / 1000)) / ln(501)), 6) AS value FROM works WHERE kudos > 0 AND word_count >= 1000", "works")
def signal_quality(spark, d):
    return value(catalog(spark, d).works.select("id", fn.quality(F.col("kudos"), F.col("word_count")).alias("value"))).where("value is not null")


@query(f"SELECT id, round(pow(2.0, -greatest(0, date_diff('day', update_date, DATE '{AS_OF}')) / 365), 6) AS value FROM works WHERE update_date IS NOT NULL", "works")
def signal_recency(spark, d):
    return value(catalog(spark, d).works.select("id", fn.recency(F.col("update_date"), F.lit(AS_OF).cast("date")).alias("value"))).where("value is not null")


@query("SELECT id, round(least(1.0, 0.6 * ln(1 + hits) / ln(1 + 1e6) + 0.4 * ln(1 + kudos) / ln(1 + 1e5)), 6) AS value FROM works", "works")
def signal_popularity(spark, d):
    return value(catalog(spark, d).works.select("id", fn.popularity(F.col("hits"), F.col("kudos")).alias("value")))


RATED = ", rated AS (SELECT id, (1500.0 + (id % 41 - 20) * 15)::DOUBLE AS mu, (50.0 + id % 300)::DOUBLE AS phi FROM works WHERE id % 3 <> 0), med AS (SELECT median(mu) AS m FROM rated)"


def ratings(works: DataFrame) -> DataFrame:
    """Deterministic ratings of two thirds of the works."""
    return works.where("id % 3 <> 0").select("id", (1500.0 + (F.col("id") % 41 - 20) * 15).alias("mu"), (50.0 + F.col("id") % 300).alias("phi"))


@query(RATED + "SELECT works.id, round(coalesce(greatest(-1.0, least(1.0, (mu - m) * greatest(0.0, least(1.0, 1 - phi / 350)) / 150)), 0.0), 6) AS value FROM works LEFT JOIN rated ON works.id = rated.id, med".replace("SELECT works.id", " SELECT works.id AS id", 1), "works")
def signal_peer_rating(spark, d):
    w = catalog(spark, d).works
    return value(rk.peer_rating(w, ratings(w)))


VOTES = """, sh AS (SELECT s.work_id AS seed, o.work_id AS other, count(*) AS co FROM reads s JOIN reads o ON s.user_id = o.user_id AND s.work_id <> o.work_id WHERE s.work_id IN (SELECT seed FROM seeds) GROUP BY 1, 2),
    nr AS (SELECT work_id, count(*) AS n FROM reads GROUP BY 1), sm AS (SELECT seed, other, co, round(co / sqrt(x.n * y.n) * co / (co + 100), 9) AS sim FROM sh JOIN nr x ON x.work_id = seed JOIN nr y ON y.work_id = other),
    votes AS (SELECT other AS id, sum(sim) AS vote FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY sim DESC, other) AS rn FROM sm) WHERE rn <= 50 AND other NOT IN (SELECT seed FROM seeds) GROUP BY 1)"""


@query(VOTES + " SELECT works.id AS id, round(least(1.0, coalesce(vote, 0) / (SELECT max(vote) FROM votes)), 6) AS value FROM works LEFT JOIN votes ON works.id = votes.id WHERE (SELECT max(vote) FROM votes) IS NOT NULL", ALL)
def signal_collab(spark, d):
    r = catalog(spark, d)
    return value(rk.collab(r.works, r.interactions, seeds(r.works)))


@query(VOTES + " SELECT id, round(vote, 6) AS vote FROM votes", ALL)
def collab_votes(spark, d):
    r = catalog(spark, d)
    return rk.collab_votes(r.interactions, seeds(r.works), 1, 50).select("id", F.round("vote", 6).alias("vote"))


WEIGHTS = ", wt AS (SELECT tag, (ascii(tag) % 7 - 3) / 3 AS weight, length(tag) AS n FROM df WHERE length(tag) % 2 = 0)"


def tag_weights(work_tags: DataFrame) -> DataFrame:
    """Deterministic weights of tags of even length."""
    return op.doc_frequency(work_tags).where("length(tag) % 2 = 0").select("tag", ((F.ascii("tag") % 7 - 3) / 3).alias("weight"), F.length("tag").alias("n"))


@query(WEIGHTS + ", p AS (SELECT work_id AS id, sum(greatest(weight, 0)) AS p, sum(abs(weight)) AS a FROM carried LEFT JOIN wt USING (tag) GROUP BY 1) SELECT id, round(CASE WHEN a > 0 THEN greatest(0.0, least(1.0, p / a)) ELSE 0.0 END, 6) AS value FROM p", "carried df")
def signal_owner_taste(spark, d):
    t = catalog(spark, d).work_tags
    return value(rk.owner_taste(t, tag_weights(t)))


@query(WEIGHTS + "SELECT work_id AS id, round(greatest(-1.0, least(1.0, sum(weight * wt.n / (wt.n + 1)))), 6) AS value FROM carried JOIN wt USING (tag) GROUP BY 1".replace("SELECT", " SELECT", 1), "carried df")
def signal_session_taste(spark, d):
    t = catalog(spark, d).work_tags
    return value(rk.session_taste(t, tag_weights(t)))


@query(
    IDF + """, ci AS (SELECT work_id, tag, idf FROM carried JOIN idf USING (tag)), m AS (SELECT work_id, sum(idf) AS m FROM ci GROUP BY 1),
    b AS (SELECT c.work_id, s.work_id AS seed, sum(c.idf) AS b FROM ci c JOIN carried s ON c.tag = s.tag AND c.work_id <> s.work_id WHERE s.work_id IN (SELECT seed FROM seeds) GROUP BY 1, 2)
    SELECT b.work_id AS id, round(max(b / (x.m + y.m - b)), 6) AS value FROM b JOIN m x ON x.work_id = b.work_id JOIN m y ON y.work_id = seed WHERE x.m + y.m - b > 0 GROUP BY 1""",
    ALL,
)
def signal_idf_overlap(spark, d):
    r = catalog(spark, d)
    return value(rk.idf_overlap(r.works, r.work_tags, seeds(r.works)))


@query(
    NBR + IDF + """, asc_ AS (SELECT dst AS tag, max(npmi) AS assoc FROM nb WHERE co >= 2 AND src IN (SELECT tag FROM st) GROUP BY 1),
    v AS (SELECT idf.tag, greatest(CASE WHEN st.tag IS NOT NULL THEN idf / ln(n) ELSE 0.0 END, coalesce(assoc, 0.0)) AS v FROM idf LEFT JOIN asc_ ON asc_.tag = idf.tag LEFT JOIN st ON st.tag = idf.tag)
    SELECT work_id AS id, round(avg(v), 6) AS value FROM carried JOIN v USING (tag) GROUP BY 1""",
    ALL,
)
def signal_tag_npmi(spark, d):
    r = catalog(spark, d)
    return value(rk.tag_npmi(r.works, r.work_tags, seeds(r.works)))


@query(
    IDF + """, s AS (SELECT work_id AS seed, tag, idf FROM carried JOIN idf USING (tag) WHERE work_id IN (SELECT seed FROM seeds)), m AS (SELECT seed, sum(idf) AS mass FROM s GROUP BY 1 HAVING sum(idf) > 0),
    h AS (SELECT work_id, seed, sum(idf) AS hit FROM carried JOIN s USING (tag) GROUP BY 1, 2) SELECT work_id AS id, round(sum(hit / mass) / (SELECT count(*) FROM m), 6) AS value FROM h JOIN m USING (seed) GROUP BY 1""",
    ALL,
)
def signal_seed_agreement(spark, d):
    r = catalog(spark, d)
    return value(rk.seed_agreement(r.works, r.work_tags, seeds(r.works)))


@query(", m AS (SELECT median(word_count) AS m FROM works WHERE id IN (SELECT seed FROM seeds) AND word_count > 0) SELECT id, round(least(word_count, m) / greatest(word_count, m), 6) AS value FROM works, m WHERE word_count > 0 AND m > 0", "works seeds")
def signal_length_fit(spark, d):
    w = catalog(spark, d).works
    return value(rk.length_fit(w, seeds(w)))


@query(
    TERMS.replace("terms AS", "WITH terms AS") + """, n AS (SELECT count(*) AS n FROM documents), t AS (SELECT term, ln((SELECT n FROM n) / count(*)) AS w FROM terms GROUP BY 1 HAVING count(*) >= 3 AND count(*) <= 0.2 * (SELECT n FROM n)),
    x AS (SELECT doc_id, term, w FROM terms JOIN t USING (term)), s AS (SELECT DISTINCT term, w FROM x WHERE doc_id IN (0, 1, 2)), ns AS (SELECT sqrt(sum(w * w)) AS ns FROM s)
    SELECT doc_id AS id, round(sum(w * w) FILTER (term IN (SELECT term FROM s)) / (sqrt(sum(w * w)) * (SELECT ns FROM ns)), 6) AS value FROM x GROUP BY 1 HAVING sum(w * w) FILTER (term IN (SELECT term FROM s)) / (sqrt(sum(w * w)) * (SELECT ns FROM ns)) >= 0.02"""
)
def summary_similarity(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return value(rk.summary_style(docs, F.col("text"), spark.createDataFrame([(0,), (1,), (2,)], "seed long")))


def tag_vectors(spark, d, work_tags: DataFrame) -> DataFrame:
    """Tags bound to embeddings in name order."""
    named = op.doc_frequency(work_tags).select("tag", (F.row_number().over(W.orderBy("tag")) - 1).cast("long").alias("vec_id"))
    return table(spark, d, "embeddings").join(F.broadcast(named), "vec_id").select("tag", F.col("embedding").alias("v"))


TV = """, tv AS (SELECT tag, embedding::DOUBLE[] AS v FROM embeddings JOIN (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS vec_id FROM df) USING (vec_id)),
    ctr AS (SELECT work_id, list(x ORDER BY p) AS v FROM (SELECT work_id, p, avg(x) AS x FROM (SELECT work_id, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM carried JOIN tv USING (tag)) GROUP BY 1, 2) GROUP BY 1)"""


@query(
    TV + """, sv AS (SELECT list(x ORDER BY p) AS v FROM (SELECT p, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS p FROM ctr WHERE work_id IN (SELECT seed FROM seeds)) GROUP BY 1))
    SELECT work_id AS id, round(list_cosine_similarity(ctr.v, sv.v), 5) AS value FROM ctr, sv WHERE list_cosine_similarity(ctr.v, sv.v) > 0""",
    ALL,
)
def signal_embedding(spark, d):
    r = catalog(spark, d)
    out = rk.taught_by(r.work_tags, tag_vectors(spark, d, r.work_tags), seeds(r.works))
    return out.select("id", F.round("value", 5).alias("value"))


SIGNALS = ["tag_overlap", "neighbourhood", "quality", "recency", "peer_rating", "popularity", "embedding", "collab", "owner_taste", "session_taste", "idf_overlap", "seed_agreement", "length_fit"]


def all_signals(r, tags_to_vectors: DataFrame, s: DataFrame | None = None, of: Roles | None = None, votes: DataFrame | None = None) -> dict[str, DataFrame]:
    """of: the works to score, seeds among them, and their tags, if not all; counts and medians are over all works."""
    s, of = seeds(r.works) if s is None else s, of or r
    w, t, x = of.works, of.work_tags, r.interactions
    return {
        "tag_overlap": rk.tag_overlap(t, s), "neighbourhood": rk.neighbourhood_pmi(r.works, r.work_tags, s, of=t), "quality": w.select("id", fn.quality(F.col("kudos"), F.col("word_count")).alias("value")), "recency": w.select("id", fn.recency(F.col("update_date"), F.lit(AS_OF).cast("date")).alias("value")),
        "peer_rating": rk.peer_rating(w, ratings(r.works)), "popularity": w.select("id", fn.popularity(F.col("hits"), F.col("kudos")).alias("value")), "embedding": rk.taught_by(t, tags_to_vectors, s), "collab": rk.collab(w, x, s, votes=votes), "owner_taste": rk.owner_taste(t, tag_weights(r.work_tags)),
        "session_taste": rk.session_taste(t, tag_weights(r.work_tags)), "idf_overlap": rk.idf_overlap(r.works, r.work_tags, s, of=t), "seed_agreement": rk.seed_agreement(r.works, r.work_tags, s, of=t), "length_fit": rk.length_fit(w, s),
    }


RANKED = ["quality", "recency", "popularity", "peer_rating", "length_fit", "idf_overlap", "tag_overlap", "collab"]


@query()
def rank_score(spark, d):
    r = catalog(spark, d)
    every = all_signals(r, tag_vectors(spark, d, r.work_tags))
    picked = {k: value(every[k]) for k in RANKED}
    cands = r.works.join(F.broadcast(seeds(r.works).withColumnRenamed("seed", "id")), "id", "left_anti")
    return rk.compose(cands, picked, rk.DEFAULT_TUNE).select("id", F.round("score", 5).alias("score"))


def _rank_sql() -> str:
    parts = []
    for k in RANKED:
        body = SQL[f"signal_{k}"]
        parts.append(f"{k}_ AS ({body})")
    weights = {"quality": 0.09, "recency": 0.09, "popularity": 0.09, "peer_rating": 0.11, "length_fit": 0.08, "idf_overlap": 0.12, "tag_overlap": 0.22, "collab": 0.16}
    cols = " + ".join(f"coalesce({k}_.value * {w}, 0)" for k, w in weights.items())
    joins = " ".join(f"LEFT JOIN {k}_ ON {k}_.id = w.id" for k in RANKED)
    opinion = " OR ".join(f"{k}_.value IS NOT NULL" for k in RANKED)
    return "WITH " + ",\n".join(parts) + f", picked AS ({SQL['top_by_kudos'].replace('LIMIT 50', 'LIMIT 3')})\nSELECT w.id AS id, round({cols}, 5) AS score FROM (SELECT p_partkey::BIGINT AS id FROM part) w {joins} WHERE ({opinion}) AND w.id NOT IN (SELECT id FROM picked)"


SQL["rank_score"] = _rank_sql()


@query()
def recommend(spark, d):
    """The whole plan: pool from the seeds, signals, composition, re-ranking for diversity; rows only (sequential re-ranking).

    Works and votes are written once. The pool is known before the signals: these are made for its works, not for all.
    """
    r = catalog(spark, d)
    works = staged(r.works.select("id", "authors", "word_count", "kudos", "hits", "update_date"), "works")
    first = staged(seeds(works), "seeds")
    votes = staged(rk.collab_votes(r.interactions, first, 1, 50), "votes")
    vectors = staged(tag_vectors(spark, d, r.work_tags), "vectors")
    edges = staged(op.strongest(op.symmetric(op.tag_pairs(r.work_tags)), 24).select("src", "dst", "co"), "edges")
    mass = staged(rel.personal_walk(edges, rk.seed_tags(r.work_tags, first)), "mass")
    pool = staged(pools.candidate_pool(works, r.work_tags, r.interactions, vectors, first, 1000, mass=mass, votes=votes).select("id"), "pool")
    ids = F.broadcast(pool.union(first.select("seed")).distinct())
    own = Roles(staged(works.join(ids, "id", "left_semi"), "own"), staged(r.work_tags.join(ids.withColumnRenamed("id", "work_id"), "work_id", "left_semi"), "tags"), r.interactions)
    every = all_signals(Roles(works, r.work_tags, r.interactions), vectors, first, own, votes)
    every |= {"walk": rk.walk_signal(own.work_tags, mass), "tag_npmi": lambda: rk.tag_npmi(works, r.work_tags, first), "latent": lambda: pools.latent(learning.als_factors(r.interactions), first)}
    scored = rk.compose(pool, every, rk.DEFAULT_TUNE)
    listed = scored.join(rk.tag_sets(own.work_tags).withColumnRenamed("work_id", "id"), "id").join(own.works.select("id", F.col("authors").alias("grp")), "id")
    return rk.mmr(listed.select(F.lit(1).cast("long").alias("request"), "id", "score", "tags", "grp"), 20)


@query()
def mmr(spark, d):
    r = catalog(spark, d)
    ranked = r.works.withColumn("request", F.col("id") % 4).withColumn("rn", F.row_number().over(W.partitionBy(F.col("id") % 4).orderBy(F.desc("kudos"), "id")))
    listed = ranked.join(rk.tag_sets(r.work_tags).withColumnRenamed("work_id", "id"), "id")
    return rk.mmr(listed.select("request", "id", F.col("kudos").cast("double").alias("score"), "tags", F.col("authors").alias("grp")), 20, 0.7, 2)


@query()
def shelf_mmr(spark, d):
    r = catalog(spark, d)
    listed = r.works.join(rk.tag_sets(r.work_tags).withColumnRenamed("work_id", "id"), "id").withColumn("request", F.dense_rank().over(W.orderBy("rating")).cast("long"))
    listed = listed.withColumn("rn", F.row_number().over(W.partitionBy("request").orderBy(F.desc("kudos"), "id")))
    return rk.mmr(listed.select("request", "id", F.col("kudos").cast("double").alias("score"), "tags", F.col("authors").alias("grp")), 10, 0.75, 0, 0.9)


# -- corpus-query modes ------------------------------------------------------------------------------------------------

HEAD = ", seed AS (SELECT tag FROM work_tags WHERE tag_type = 'name' GROUP BY 1 ORDER BY count(*) DESC, tag LIMIT 1)"


@query(
    HEAD + """, own AS (SELECT work_id FROM carried WHERE tag = (SELECT tag FROM seed)),
    co AS (SELECT tag, count(*) AS co FROM carried WHERE work_id IN (SELECT work_id FROM own) AND tag <> (SELECT tag FROM seed) GROUP BY 1 ORDER BY co DESC, tag LIMIT 200),
    p AS (SELECT co.tag, co, df, round(ln(co / ((SELECT count(*) FROM own) * df / n)), 9) AS pmi FROM co JOIN df ON co.tag = df.tag, total)
    SELECT tag, co, df, round(pmi, 6) AS pmi FROM p WHERE pmi > 0 ORDER BY p.pmi DESC, co DESC, tag LIMIT 50""",
    "work_tags carried df total",
)
def tag_neighbours(spark, d):
    r = catalog(spark, d)
    return rk.tag_neighbours(r.works, r.work_tags, rk.head_tag(r.work_tags, "name")).withColumn("pmi", F.round("pmi", 6))


@query(
    HEAD + """, u AS (SELECT DISTINCT work_id, tag FROM work_tags WHERE tag_type = 'brand'), hit AS (SELECT DISTINCT work_id FROM carried WHERE tag IN (SELECT tag FROM seed)),
    z AS (SELECT tag, count(*) AS works, count(*) FILTER (work_id IN (SELECT work_id FROM hit)) AS co FROM u GROUP BY 1)
    SELECT tag, works, co, round((co / works) / ((SELECT count(*) FROM hit) / n), 6) AS lift FROM z, total WHERE co >= 2 AND works >= 2""",
    "work_tags carried total",
)
def fandom_ranking(spark, d):
    r = catalog(spark, d)
    out = rk.fandom_ranking(r.works, r.work_tags, "brand", rk.head_tag(r.work_tags, "name"), 2)
    return out.withColumn("lift", F.round("lift", 6))


@query("SELECT tag, count(*) AS works, CASE WHEN tag = 'Brand#11' THEN count(*) ELSE 0 END AS co, CASE WHEN tag = 'Brand#11' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lift FROM (SELECT DISTINCT work_id, tag FROM work_tags WHERE tag_type = 'brand') GROUP BY 1 HAVING count(*) >= 2", "work_tags")
def fandom_ranking_literal(spark, d):
    r = catalog(spark, d)
    return rk.fandom_ranking(r.works, r.work_tags, "brand", spark.createDataFrame([("Brand#11",)], "tag string"), 2, literal=True)


UNDER = ", r AS (SELECT id, kudos, round((kudos + coalesce(bookmarks, 0)) / hits, 9) AS ratio FROM works WHERE hits >= 1), k AS (SELECT * FROM r ORDER BY ratio {}, kudos DESC, id LIMIT 30) SELECT id, kudos, round(ratio, 6) AS ratio, row_number() OVER (ORDER BY k.ratio DESC, kudos DESC, id) AS place FROM k"


@query(UNDER.format("ASC"), "works")
def underrated(spark, d):
    return rk.underrated(catalog(spark, d).works, 30).select("id", "kudos", F.round("ratio", 6).alias("ratio"), "place")


@query(UNDER.format("DESC"), "works")
def underrated_descending(spark, d):
    return rk.underrated(catalog(spark, d).works, 30, best_last=True).select("id", "kudos", F.round("ratio", 6).alias("ratio"), "place")


@query(", ok AS (SELECT work_id FROM carried GROUP BY 1 HAVING count(*) >= 5) SELECT coalesce(min(work_id) FILTER (work_id BETWEEN 77 AND 77 + 511), min(work_id)) AS id FROM ok", "carried")
def surprise(spark, d):
    r = catalog(spark, d)
    return rk.surprise(r.works, r.work_tags, 5, 77)


@query(
    HEAD + """, dated AS (SELECT id AS work_id, update_date FROM works WHERE update_date IS NOT NULL), clk AS (SELECT max(update_date) AS now FROM dated),
    own AS (SELECT work_id, date_diff('day', update_date, (SELECT now FROM clk)) AS age FROM carried JOIN dated USING (work_id) WHERE tag IN (SELECT tag FROM seed)),
    fl AS (SELECT greatest(5, least(200, count(*) // 10)) AS f FROM own),
    win AS (SELECT coalesce(min(w), 3650) AS w FROM (SELECT unnest([90, 180, 365, 730, 1460, 3650]) AS w) WHERE (SELECT count(*) FROM own WHERE age < w) >= (SELECT f FROM fl)),
    a AS (SELECT count(*) FILTER (date_diff('day', update_date, (SELECT now FROM clk)) < (SELECT w FROM win)) AS an, count(*) AS atot FROM dated),
    p AS (SELECT tag, count(*) AS co, count(*) FILTER (age < (SELECT w FROM win)) AS co_new FROM carried JOIN own USING (work_id) WHERE tag NOT IN (SELECT tag FROM seed) GROUP BY 1 HAVING count(*) >= 3)
    SELECT tag, (SELECT w FROM win)::INT AS "window", co, co_new, round((co_new / co) / (an / atot), 6) AS growth FROM p, a WHERE an > 0""",
    "works work_tags carried",
)
def tag_trend(spark, d):
    r = catalog(spark, d)
    return rk.tag_trend(r.works, r.work_tags, rk.head_tag(r.work_tags, "name")).withColumn("growth", F.round("growth", 6))


@query(
    HEAD + """, own AS (SELECT work_id FROM carried WHERE tag IN (SELECT tag FROM seed)), co AS (SELECT tag, count(*) AS co FROM carried WHERE work_id IN (SELECT work_id FROM own) GROUP BY 1),
    stt AS (SELECT df.tag, df, coalesce(co, 0) AS co, n, round(coalesce(co, 0) * n / ((SELECT count(*) FROM own) * df), 9) AS lift FROM df LEFT JOIN co ON co.tag = df.tag, total WHERE df.tag NOT IN (SELECT tag FROM seed)),
    near AS (SELECT tag FROM stt WHERE co >= 5 ORDER BY lift DESC, tag LIMIT 10),
    hw AS (SELECT DISTINCT work_id FROM carried WHERE tag IN (SELECT tag FROM near) AND work_id NOT IN (SELECT work_id FROM own)),
    th AS (SELECT tag, count(*) AS support FROM carried WHERE work_id IN (SELECT work_id FROM hw) GROUP BY 1),
    cd AS (SELECT tag, support, co, lift, df, n FROM th JOIN stt USING (tag) WHERE tag NOT IN (SELECT tag FROM near) AND df >= 10 AND support >= 5 ORDER BY round(support / df, 9) DESC, tag LIMIT 150),
    g AS (SELECT *, 1 + ((support / (SELECT count(*) FROM hw)) / (df / n) - 1) * support / (support + 100.0) AS shrunk FROM cd), h AS (SELECT *, round((shrunk - 1) * (1 - lift), 9) AS gap FROM g WHERE lift < 1 AND shrunk > 1)
    SELECT tag, support, co, round(lift, 6) AS lift, round(gap, 6) AS gap FROM h WHERE (SELECT count(*) FROM own) >= 5 ORDER BY h.gap DESC, tag LIMIT 20""",
    "work_tags carried df total",
)
def tag_gap(spark, d):
    r = catalog(spark, d)
    out = rk.tag_gap(r.works, r.work_tags, rk.head_tag(r.work_tags, "name"), 10, 5, 5, 10)
    return out.withColumn("lift", F.round("lift", 6)).withColumn("gap", F.round("gap", 6))


# -- related entities --------------------------------------------------------------------------------------------------


@query(VOTES + " SELECT seed, other, co, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY sim DESC, other) AS rank FROM sm) WHERE rank <= 20", ALL)
def related_collab(spark, d):
    r = catalog(spark, d)
    return rel.best_of(rk.co_similarity_of(r.interactions, seeds(r.works), 1), "seed", "other", "sim", 20).select("seed", "other", "co", F.round("sim", 6).alias("sim"), "rank")


@query(
    """, dg AS (SELECT user_id, count(*) AS deg FROM reads GROUP BY 1), a AS (SELECT s.work_id AS seed, o.work_id AS other, round(sum(1 / (1 + log10(1 + deg))), 9) AS score FROM reads s JOIN reads o ON s.user_id = o.user_id AND s.work_id <> o.work_id JOIN dg ON dg.user_id = s.user_id WHERE s.work_id IN (SELECT seed FROM seeds) GROUP BY 1, 2)
    SELECT seed, other, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, other) AS rank FROM a) WHERE rank <= 20""",
    ALL,
)
def related_adamic(spark, d):
    r = catalog(spark, d)
    return rel.adamic(r.interactions, seeds(r.works), 20).select("seed", "other", F.round("score", 5).alias("score"), "rank")


@query(
    """, s AS (SELECT DISTINCT seed, tag FROM carried JOIN seeds ON work_id = seed), x AS (SELECT DISTINCT seed, c.work_id AS other FROM carried c JOIN s USING (tag) WHERE c.work_id <> seed)
    SELECT seed, other, kudos, rank FROM (SELECT seed, other, kudos, row_number() OVER (PARTITION BY seed ORDER BY kudos DESC, other) AS rank FROM x JOIN works ON id = other) WHERE rank <= 20""",
    ALL,
)
def related_popular_works(spark, d):
    r = catalog(spark, d)
    return rel.popular_within_tags(r.works, r.work_tags, seeds(r.works), 20)


@query(
    HEAD + """, j AS (SELECT src, dst, round(co / (a.df + b.df - co), 9) AS jac FROM sym JOIN df a ON a.tag = src JOIN df b ON b.tag = dst WHERE src IN (SELECT tag FROM seed))
    SELECT src, dst, round(jac, 6) AS jac, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY jac DESC, dst) AS rank FROM j) WHERE rank <= 20""",
    "work_tags sym df",
)
def related_tag_jaccard(spark, d):
    t = catalog(spark, d).work_tags
    return rel.tag_jaccard(t, rk.head_tag(t, "name"), 20).withColumn("jac", F.round("jac", 6))


AUTH = ", aut AS (SELECT DISTINCT authors AS author, tag FROM carried JOIN works ON id = work_id WHERE tag <> authors)"


@query(
    AUTH + """, p AS (SELECT a.author AS author, b.author AS other, round(sum(log10(1 + n / df)), 9) AS score FROM aut a JOIN aut b ON a.tag = b.tag AND a.author <> b.author JOIN df ON df.tag = a.tag, total GROUP BY 1, 2)
    SELECT author, other, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY score DESC, other) AS rank FROM p) WHERE rank <= 5""",
    ALL,
)
def related_authors_tagidf(spark, d):
    r = catalog(spark, d)
    return rel.authors_by_tags(r.works, r.work_tags, 5).withColumn("score", F.round("score", 5))


@query(
    """, ar AS (SELECT DISTINCT authors AS author, user_id FROM reads JOIN works ON id = work_id), p AS (SELECT a.author, b.author AS other, count(*) AS shared FROM ar a JOIN ar b ON a.user_id = b.user_id AND a.author <> b.author GROUP BY 1, 2)
    SELECT author, other, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY shared DESC, other) AS rank FROM p) WHERE rank <= 5""",
    ALL,
)
def related_authors_cobook(spark, d):
    r = catalog(spark, d)
    return rel.authors_by_readers(r.works, r.interactions, 5)


@query(
    AUTH + """, cnt AS (SELECT authors AS author, tag, count(*) * ln(n / any_value(df.df)) AS w FROM carried JOIN works ON id = work_id JOIN df USING (tag), total WHERE tag <> authors AND df.df >= 3 AND df.df < n GROUP BY authors, tag, n),
    nm AS (SELECT author, sqrt(sum(w * w)) AS nm FROM cnt GROUP BY 1), p AS (SELECT a.author, b.author AS other, round(sum(a.w * b.w) / (any_value(x.nm) * any_value(y.nm)), 9) AS sim FROM cnt a JOIN cnt b ON a.tag = b.tag AND a.author <> b.author JOIN nm x ON x.author = a.author JOIN nm y ON y.author = b.author GROUP BY 1, 2)
    SELECT author, other, round(sim, 5) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY sim DESC, other) AS rank FROM p) WHERE rank <= 5""",
    ALL,
)
def similar_authors(spark, d):
    r = catalog(spark, d)
    return rel.similar_authors(r.works, r.work_tags, 5).withColumn("sim", F.round("sim", 5))


@query(
    """, f AS (SELECT work_id, tag FROM work_tags WHERE tag_type = 'name'), s AS (SELECT tag FROM f WHERE work_id = (SELECT seed FROM seeds LIMIT 1)),
    b AS (SELECT work_id AS id, count(DISTINCT tag) FILTER (tag IN (SELECT tag FROM s)) AS shared, count(DISTINCT tag) FILTER (tag NOT IN (SELECT tag FROM s)) AS others FROM f WHERE work_id <> (SELECT seed FROM seeds LIMIT 1) GROUP BY 1)
    SELECT b.id, shared, others, kudos FROM b JOIN works USING (id) WHERE shared >= 1 AND others >= 1 ORDER BY others DESC, kudos DESC, b.id LIMIT 25""",
    "works work_tags seeds",
)
def bridges(spark, d):
    r = catalog(spark, d)
    return rel.bridges(r.works, r.work_tags, "name", seeds(r.works, 1), 25)


@query(
    TV + """, sm AS (SELECT tag, ln(1 + n / (1 + df)) AS w FROM df, total), pr AS (SELECT id AS x, id + 1 AS y FROM works WHERE id + 1 IN (SELECT id FROM works)),
    tw AS (SELECT work_id, tag, w FROM carried JOIN sm USING (tag)), ms AS (SELECT work_id, sum(w) AS m FROM tw GROUP BY 1),
    bo AS (SELECT x, y, sum(a.w) AS b FROM pr JOIN tw a ON a.work_id = x JOIN tw c ON c.work_id = y AND c.tag = a.tag GROUP BY 1, 2)
    SELECT pr.x, pr.y, round((coalesce(b, 0) / (p.m + q.m - coalesce(b, 0)) + greatest(0, list_cosine_similarity(u.v, v.v))) / 2, 5) AS sim FROM pr LEFT JOIN bo ON bo.x = pr.x AND bo.y = pr.y JOIN ms p ON p.work_id = pr.x JOIN ms q ON q.work_id = pr.y JOIN ctr u ON u.work_id = pr.x JOIN ctr v ON v.work_id = pr.y""",
    ALL,
)
def pair_similarity(spark, d):
    return neighbour_similarity(spark, d, "true")


def neighbour_similarity(spark, d, which: str) -> DataFrame:
    r = catalog(spark, d)
    pairs = r.works.where(which).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    out = rel.pair_similarity(pairs, r.works, r.work_tags, rk.mean_vectors(r.work_tags, tag_vectors(spark, d, r.work_tags)))
    return out.select("x", "y", F.round("sim", 5).alias("sim"))


@query()
def ppr_walk(spark, d):
    r = catalog(spark, d)
    edges = op.strongest(op.symmetric(op.tag_pairs(r.work_tags)), 24)
    return rel.personal_walk(edges, rk.head_tag(r.work_tags, "name"), rounds=8)


@query()
def signal_walk(spark, d):
    r = catalog(spark, d)
    edges = op.strongest(op.symmetric(op.tag_pairs(r.work_tags)), 24)
    mass = rel.personal_walk(edges, rk.head_tag(r.work_tags, "name"), rounds=6)
    return rk.walk_signal(r.work_tags, mass)


@query()
def reading_path(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return rel.reading_path(v, 0, 10)


@query(
    """, mv AS (SELECT list(x ORDER BY p) AS m FROM (SELECT p, avg(x) AS x FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY 1))
    SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], m), 5) AS sim, list_cosine_similarity(embedding::DOUBLE[], m) >= 0.3 AS central FROM embeddings, mv""",
    "df",
)
def center_similarity(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return rel.center_similarity(v, 0.3).withColumn("sim", F.round("sim", 5))

"""Preparation, filters, joins, aggregates, windows, top-k and set operators over the role relations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import scoring as fn


# -- preparation -----------------------------------------------------------------------------------------------------


def carried(work_tags: DataFrame) -> DataFrame:
    """A tag once per work, whatever types it stands under."""
    return work_tags.select("work_id", "tag").distinct()


def apart(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the works: merged, never broadcast.

    Spark judges it by its compressed file, where millions of works and tags count as a few MB, and would gather them in the driver.
    """
    return df.hint("merge")


def row_frequency(work_tags: DataFrame) -> DataFrame:
    return work_tags.groupBy("tag").agg(F.count("*").alias("df"))


def doc_frequency(work_tags: DataFrame) -> DataFrame:
    return carried(work_tags).groupBy("tag").agg(F.count("*").alias("df"))


def tag_pairs(work_tags: DataFrame) -> DataFrame:
    """(a, b, co) with a < b and the number of works that carry both."""
    c = carried(work_tags)
    x, y = c.select("work_id", F.col("tag").alias("a")), c.select("work_id", F.col("tag").alias("b"))
    return apart(x).join(apart(y), "work_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("co"))


def symmetric(pairs: DataFrame) -> DataFrame:
    """(src, dst, co) in both directions."""
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return pairs.select(both.alias("e"), "co").select("e.src", "e.dst", "co")


def strongest(edges: DataFrame, n: int) -> DataFrame:
    """At most n edges a node, strongest first, names breaking ties."""
    w = W.partitionBy("src").orderBy(F.desc("co"), "dst")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def graph_nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("tag")).union(pairs.select(F.col("b").alias("tag"))).distinct()


def reads(interactions: DataFrame) -> DataFrame:
    return interactions.select("user_id", "work_id").distinct()


def bookmark_counts(interactions: DataFrame) -> DataFrame:
    return reads(interactions).groupBy("work_id").agg(F.count("*").alias("readers"))


def co_bookmarks(interactions: DataFrame, gate: int) -> DataFrame:
    """(a, b, co): works read by at least `gate` readers in common, a < b."""
    r = reads(interactions)
    x, y = r.select("user_id", F.col("work_id").alias("a")), r.select("user_id", F.col("work_id").alias("b"))
    return x.join(y, "user_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("co")).where(F.col("co") >= gate)


def adaptive_gate(pairs: DataFrame, enough: int = 1000) -> DataFrame:
    """One row: how many pairs have two readers or more in common, and the gate that follows."""
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("co") >= 2).alias("firm")).withColumn("gate", F.when(F.col("firm") >= enough, 2).otherwise(1))


def term_frequency(texts: Column, docs: DataFrame, least: int = 3, most_share: float = 0.2) -> DataFrame:
    total = docs.agg(F.count("*").alias("n"))
    words = docs.select(F.explode(fn.summary_words(texts)).alias("term")).where(~F.col("term").isin(fn.STOPWORDS))
    counts = words.groupBy("term").agg(F.count("*").alias("df"))
    return counts.join(F.broadcast(total)).where((F.col("df") >= least) & (F.col("df") <= most_share * F.col("n"))).select("term", "df")


def author_readers(works: DataFrame, interactions: DataFrame) -> DataFrame:
    """Distinct (author, reader) over normalised author names."""
    by = works.select(F.col("id").alias("work_id"), F.explode(fn.authors_of(F.col("authors"))).alias("a")).select("work_id", fn.author_key(F.col("a")).alias("author"))
    return interactions.join(by, "work_id").select("author", "user_id").distinct()


# -- filters and joins -----------------------------------------------------------------------------------------------


def filtered(works: DataFrame, words_min=None, words_max=None, kudos_min=None, complete=None, ratings=(), languages=(), not_updated_days=None, as_of=None) -> DataFrame:
    """The ranking filter: absent numbers and texts count as 0 and '', an unknown completion matches neither way."""
    if words_min is not None and words_max is not None and words_min > words_max:
        raise ValueError("words_min is above words_max")
    c = lambda x: F.coalesce(F.col(x), F.lit(0))
    if words_min is not None:
        works = works.where(c("word_count") >= words_min)
    if words_max is not None:
        works = works.where(c("word_count") <= words_max)
    if kudos_min is not None:
        works = works.where(c("kudos") >= kudos_min)
    if complete is not None:
        works = works.where(F.col("complete") == complete)
    if ratings:
        works = works.where(F.col("rating").isin(list(ratings)))
    if languages:
        works = works.where(F.lower(F.coalesce("language", F.lit(""))).isin([x.lower() for x in languages]))
    if not_updated_days is not None:
        works = works.where(F.date_diff(F.lit(as_of).cast("date"), "update_date") >= not_updated_days)
    return works


def without_tags(works: DataFrame, work_tags: DataFrame, blocked: DataFrame) -> DataFrame:
    """Works that carry no blocked tag (names compare without case)."""
    bad = work_tags.join(F.broadcast(blocked.select(F.lower("tag").alias("k")).distinct()), F.lower("tag") == F.col("k"), "left_semi").select(F.col("work_id").alias("id"))
    return works.join(bad, "id", "left_anti")


def unknown_names(names: DataFrame, work_tags: DataFrame) -> DataFrame:
    return names.join(work_tags.select(F.lower("tag").alias("k")).distinct(), F.lower("tag") == F.col("k"), "left_anti")


def unseen(works: DataFrame, seen: DataFrame, kind: str = "work") -> DataFrame:
    """Works whose 'kind:id' key is not among the seen entity ids."""
    return works.withColumn("entity_id", F.concat(F.lit(f"{kind}:"), F.col("id").cast("string"))).join(seen.select("entity_id").distinct(), "entity_id", "left_anti")


def k_anonymous(interactions: DataFrame, k: int) -> DataFrame:
    return reads(interactions).groupBy("user_id").agg(F.count("*").alias("works")).where(F.col("works") >= k)


def shared_readers(interactions: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, other, shared): how many readers each other work has in common with each seed."""
    r = reads(interactions)
    near = r.join(F.broadcast(seeds.select(F.col("seed").alias("work_id"))), "work_id").select("user_id", F.col("work_id").alias("seed"))
    return r.join(near, "user_id").where("work_id <> seed").groupBy("seed", F.col("work_id").alias("other")).agg(F.count("*").alias("shared"))


def family_browse(works: DataFrame, work_tags: DataFrame, universe: list[str], concept: list[str], as_of, days: int) -> DataFrame:
    """Recent works of a universe that carry a concept, with the matched tags and a score that ages."""
    tags = work_tags.withColumn("k", F.lower("tag"))
    of = lambda names: tags.where(F.col("k").isin([n.lower() for n in names]))
    matched = of(concept).groupBy(F.col("work_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("matched"))
    age = F.date_diff(F.lit(as_of).cast("date"), "update_date")
    found = works.join(of(universe).select(F.col("work_id").alias("id")), "id", "left_semi").join(matched, "id")
    return found.withColumn("age", age).where((F.col("age") >= 0) & (F.col("age") <= days)).withColumn("score", fn.browse_score(F.col("kudos"), F.col("age")))


def search(works: DataFrame, text: str, most_tokens: int = 8) -> DataFrame:
    """Works whose title or authors hold every token; tier 1: title is the query, 2: title starts with it, 3: the rest."""
    low = text.lower()
    title, authors = F.lower("title"), F.lower("authors")
    for t in low.split()[:most_tokens]:
        works = works.where(F.contains(title, F.lit(t)) | F.contains(authors, F.lit(t)))
    return works.withColumn("tier", F.when(title == low, 1).when(F.startswith(title, F.lit(low)), 2).otherwise(3))


def fuzzy_match(entries: DataFrame, works: DataFrame, most: int = 2) -> DataFrame:
    """Resolve (entry, title, author) to works: exact title and author, then a near title of the same author, then title alone.

    The first method that matches wins, the smallest id within it. Spellings meet, not entries and works: each stands for its
    smallest id, so that many works of one title or author don't multiply.
    """
    t, a = F.lower(F.trim("title")), fn.author_key(F.col("authors"))
    w = works.select(F.col("id"), t.alias("wt"), a.alias("wa")).groupBy("wt", "wa").agg(F.min("id").alias("id"))
    e = entries.select("entry", F.lower(F.trim("title")).alias("et"), fn.author_key(F.col("author")).alias("ea"))
    k = e.select("et", "ea").distinct()
    exact = k.join(w, (F.col("et") == F.col("wt")) & (F.col("ea") == F.col("wa"))).select("et", "ea", "id", F.lit(1).alias("method"))
    near = k.join(w, F.col("ea") == F.col("wa")).where(F.levenshtein("et", "wt", most) >= 0).select("et", "ea", "id", F.lit(2).alias("method"))
    title = k.join(w.groupBy("wt").agg(F.min("id").alias("id")), F.col("et") == F.col("wt")).select("et", "ea", "id", F.lit(3).alias("method"))
    best = exact.union(near).union(title).groupBy(F.col("et").alias("bt"), F.col("ea").alias("ba")).agg(F.min(F.struct("method", "id")).alias("b"))
    best = apart(e).join(best, (F.col("et") == F.col("bt")) & F.col("ea").eqNullSafe(F.col("ba"))).groupBy("entry").agg(F.min("b").alias("b"))
    return best.select("entry", F.col("b.method").alias("method"), F.col("b.id").alias("id"))


def retag(work_tags: DataFrame, known: DataFrame, loose: str) -> DataFrame:
    """Replace the type of rows under `loose` by the type known for their tag; rows that then coincide are one."""
    k = known.select(F.col("tag"), F.col("tag_type").alias("new_type"))
    new = work_tags.join(k, "tag", "left").withColumn("tag_type", F.when(F.col("tag_type") == loose, F.coalesce("new_type", "tag_type")).otherwise(F.col("tag_type")))
    return new.select("work_id", "tag", "tag_type").distinct()


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(shard, change) of manifests (shard, digest): added, removed or changed."""
    both = old.select("shard", F.col("digest").alias("was")).join(new.select("shard", F.col("digest").alias("now")), "shard", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select("shard", change.alias("change")).where("change is not null")


# -- aggregates ------------------------------------------------------------------------------------------------------


def upper_median(x: str) -> Column:
    """The upper of the two middle values of a column. Counts per distinct value are held, never the rows of a group."""
    return F.expr(f"-(percentile_disc(0.5) WITHIN GROUP (ORDER BY -{x}))")


def nearest_rank(x: str, p: float) -> Column:
    """Smallest value of a column whose rank reaches p of the count."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})")


def tag_shelf(works: DataFrame, work_tags: DataFrame) -> DataFrame:
    """Per tag: works, totals, whole-number means, upper medians, and the most bookmarked work."""
    w = carried(work_tags).join(works.withColumnRenamed("id", "work_id"), "work_id")
    mean = lambda c: F.expr(f"sum({c}) div count(*)")
    return w.groupBy("tag").agg(
        F.count("*").alias("works"),
        F.sum("word_count").alias("words"),
        mean("word_count").alias("mean_words"),
        upper_median("word_count").cast("long").alias("median_words"),
        mean("kudos").alias("mean_kudos"),
        upper_median("kudos").cast("long").alias("median_kudos"),
        F.min_by("work_id", F.struct(-F.coalesce("bookmarks", F.lit(0)), "work_id")).alias("top_work"),
    )


def shelf_years(works: DataFrame, work_tags: DataFrame, latest: int = 12) -> DataFrame:
    """Works per tag and year, the latest years only, as a share of the tag's busiest of these."""
    w = carried(work_tags).join(works.withColumnRenamed("id", "work_id"), "work_id").where("update_date is not null")
    per = w.groupBy("tag", F.year("update_date").alias("year")).agg(F.count("*").alias("works"))
    newest = W.partitionBy("tag").orderBy(F.desc("year"))
    per = per.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= latest)
    return per.withColumn("share", F.col("works") / F.max("works").over(W.partitionBy("tag"))).drop("rn")


def shrunk_mean(groups: DataFrame, key: str, value: str, prior_weight: float = 10.0) -> DataFrame:
    """(sum + weight*prior) / (n + weight) per group; the prior is the mean over all positive values."""
    prior = groups.where(F.col(value) > 0).agg(F.avg(value).alias("prior"))
    per = groups.groupBy(key).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return per.join(F.broadcast(prior)).withColumn("shrunk", (F.col("total") + prior_weight * F.col("prior")) / (F.col("n") + prior_weight))


def tag_candidates(work_tags: DataFrame, least: int, limit: int) -> DataFrame:
    return row_frequency(work_tags).where(F.col("df") >= least).orderBy(F.desc("df"), "tag").limit(limit)


def author_head(works: DataFrame) -> DataFrame:
    """Works per author key, and the name to show: the longest, then the smallest."""
    a = works.select(F.explode(fn.authors_of(F.col("authors"))).alias("name")).withColumn("author", fn.author_key(F.col("name")))
    return a.groupBy("author").agg(F.count("*").alias("works"), F.min_by("name", F.struct(-F.length("name"), "name")).alias("name"))


def velocity(marks: DataFrame, owner: str, at: str) -> DataFrame:
    """Marks a day per owner at the median and the ninth decile of owners (nearest rank), and whether they tell owners apart.

    They do where a fifth of the owners (one at least) have five days or more, and the ninth decile is twice the median.
    """
    per = marks.groupBy(owner).agg(F.count("*").alias("marks"), F.countDistinct(F.to_date(at)).alias("days")).withColumn("pace", F.col("marks") / F.col("days"))
    out = per.agg(F.count("*").alias("owners"), F.sum("marks").alias("marks"), F.sum("days").alias("reader_days"), F.count_if(F.col("days") >= 5).alias("thick"), nearest_rank("pace", 0.5).alias("p50"), nearest_rank("pace", 0.9).alias("p90"))
    need = F.greatest(F.lit(1), F.floor(F.col("owners") * 0.2 + 0.5))
    return out.withColumn("verdict", F.when(F.col("thick") < need, "thin").when((F.col("p50") > 0) & (F.col("p90") / F.col("p50") < 2), "flat").otherwise("meets"))


def seasons(works: DataFrame, work_tags: DataFrame, least: int) -> DataFrame:
    """Per tag its best month: lift of the month's share among the tag's works over all works, and how many years agree."""
    dated = works.where("update_date is not null").select(F.col("id").alias("work_id"), F.month("update_date").alias("month"), F.year("update_date").alias("year"))
    t = carried(work_tags).join(dated, "work_id")
    month = dated.groupBy("month").agg(F.count("*").alias("all_month"))
    total = dated.agg(F.count("*").alias("all_works"))
    per = t.groupBy("tag", "month").agg(F.count("*").alias("works"))
    per = per.withColumn("support", F.sum("works").over(W.partitionBy("tag"))).where(F.col("support") >= least)
    lift = (F.col("works") / F.col("support")) / (F.col("all_month") / F.col("all_works"))
    per = per.join(F.broadcast(month), "month").join(F.broadcast(total)).withColumn("lift", lift)
    best = per.withColumn("rn", F.row_number().over(W.partitionBy("tag").orderBy(F.desc(F.round("lift", 9)), "month"))).where("rn = 1")
    peak = t.groupBy("tag", "year", "month").agg(F.count("*").alias("n"))
    peak = peak.withColumn("rn", F.row_number().over(W.partitionBy("tag", "year").orderBy(F.desc("n"), "month"))).where("rn = 1").select("tag", F.col("month").alias("peak"))
    agree = best.join(peak, "tag").groupBy("tag").agg(F.count("*").alias("years"), F.avg((F.col("peak") == F.col("month")).cast("double")).alias("year_share"))
    return best.select("tag", "month", "lift", "works", "support").join(agree, "tag")


def passed_over(lost: DataFrame, work_tags: DataFrame) -> DataFrame:
    """Tags that every work of `lost` (work_id) carries."""
    n = lost.select("work_id").distinct()
    total = n.agg(F.count("*").alias("n_lost"))
    per = carried(work_tags).join(n, "work_id").groupBy("tag").agg(F.count("*").alias("works"))
    return per.join(F.broadcast(total)).where("works = n_lost").select("tag", "works")


def why_lines(works: DataFrame, work_tags: DataFrame, least: int, top: int = 3) -> DataFrame:
    """Per brand its tags of highest lift against all works."""
    c = carried(work_tags).join(works.select(F.col("id").alias("work_id"), F.col("authors").alias("brand")), "work_id")
    here = c.groupBy("brand", "tag").agg(F.count("*").alias("here"))
    size, df, total = works.groupBy(F.col("authors").alias("brand")).agg(F.count("*").alias("size")), doc_frequency(work_tags), works.agg(F.count("*").alias("n"))
    out = here.where((F.col("here") >= least) & (F.col("tag") != F.col("brand"))).join(size, "brand").join(df, "tag").join(F.broadcast(total))
    out = out.withColumn("lift", F.round(F.col("here") * F.col("n") / (F.col("size") * F.col("df")), 9))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("brand").orderBy(F.desc("lift"), "tag"))).where(F.col("rank") <= top).select("brand", "tag", "here", "lift", "rank")


def distinctive(work_tags: DataFrame, works: DataFrame, n: int) -> DataFrame:
    """A work's rarest tags: fewest carriers first, names breaking ties; tags of all works are none."""
    total = works.agg(F.count("*").alias("total"))
    c = carried(work_tags).join(doc_frequency(work_tags), "tag").join(F.broadcast(total)).where("df < total")
    return c.withColumn("rank", F.row_number().over(W.partitionBy("work_id").orderBy("df", "tag"))).where(F.col("rank") <= n).select("work_id", "tag", "df", "rank")


# -- ranks and correlations ------------------------------------------------------------------------------------------


def average_rank(df: DataFrame, by: str, name: str, part: list[str] = ()) -> DataFrame:
    """Rank from the smallest, ties share their mean rank."""
    w, same = W.partitionBy(*part).orderBy(by), W.partitionBy(*part, by)
    return df.withColumn(name, F.rank().over(w) + (F.count("*").over(same) - 1) / 2)


def spearman(df: DataFrame, x: str, y: str, part: list[str] = ()) -> DataFrame:
    r = average_rank(average_rank(df, x, "rx", part), y, "ry", part)
    return r.groupBy(*part).agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def kendall(df: DataFrame, key: str, x: str, y: str, part: str) -> DataFrame:
    """(concordant - discordant) / decided pairs within each part."""
    a = df.select(F.col(part), F.col(key).alias("i"), F.col(x).alias("xi"), F.col(y).alias("yi"))
    b = df.select(F.col(part), F.col(key).alias("j"), F.col(x).alias("xj"), F.col(y).alias("yj"))
    s = F.signum((F.col("xi") - F.col("xj")).cast("double")) * F.signum((F.col("yi") - F.col("yj")).cast("double"))
    met = a.join(b, part).where("i < j").withColumn("s", s)
    return met.groupBy(part).agg((F.sum("s") / F.count_if(F.col("s") != 0)).alias("tau"), F.count_if(F.col("s") != 0).cast("long").alias("decided"))


def top_per_group_mean(df: DataFrame, group: str, score: str, key: str, n: int) -> DataFrame:
    """Mean of a group's n best scores."""
    w = W.partitionBy(group).orderBy(F.desc(score), key)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).groupBy(group).agg(F.avg(score).alias("mean_score"), F.count("*").alias("n"))


# -- top-k and sets --------------------------------------------------------------------------------------------------


def top_by(works: DataFrame, column: str, k: int, skip: int = 0) -> DataFrame:
    return works.orderBy(F.coalesce(F.col(column), F.lit(0)).desc(), "id").offset(skip).limit(k)


def places(df: DataFrame, by: str, key: str) -> DataFrame:
    """df with place, from the largest of a whole-numbered column, ties by key: ranks within a value behind the count of all above it."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    above = counts.select(by, (F.sum("n").over(W.orderBy(F.desc(by))) - F.col("n")).alias("above"))
    return df.join(above, by).withColumn("place", F.col("above") + F.row_number().over(W.partitionBy(by).orderBy(key))).drop("above")


def newest(works: DataFrame, k: int) -> DataFrame:
    return works.orderBy(F.col("update_date").desc_nulls_last(), "id").limit(k)


def nearest(vectors: DataFrame, query: DataFrame, k: int, least: float, skip: DataFrame | None = None) -> DataFrame:
    """(query_id, id, sim): the k vectors of highest cosine to each query at `least` or more, itself left out; ids break ties.

    Vectors (id, v) and queries (query_id, qv) are dealt to blocks; each two of one width meet as matrix products, so that no
    row is made for a pair. Blocks hand on what can be among the k best after rounding, with cosines summed in order.
    """
    vectors = vectors.join(skip, "id", "left_anti") if skip is not None else vectors
    if vectors.schema["v"].dataType != query.schema["qv"].dataType:
        vectors, query = vectors.withColumn("v", F.col("v").cast("array<double>")), query.withColumn("qv", F.col("qv").cast("array<double>"))
    rows, asked = vectors.count(), query.count()
    block = min(65_536, max(4_096, rows // 128))
    ni, nj = max(1, -(-rows // block)), max(1, -(-asked // 16_384))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    v = vectors.where("id is not null and v is not null").select(F.size("v").alias("width"), deal("id", ni).alias("i"), every(nj).alias("j"), "id", none(query, "query_id").alias("query_id"), "v")
    q = query.where("query_id is not null and qv is not null").select(F.size("qv").alias("width"), every(ni).alias("i"), deal("query_id", nj).alias("j"), none(vectors, "id").alias("id"), "query_id", F.col("qv").alias("v"))
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("query_id", query), ("id", vectors))}
    met = v.union(q).groupBy("width", "i", "j").applyInArrow(_best_of_blocks(k, least), f"query_id {kinds['query_id']}, id {kinds['id']}, sim double")
    met = met.where("id <> query_id").withColumn("sim", F.round("sim", 9))
    w = W.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return met.where(F.col("sim") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "sim", "rank")


def _best_of_blocks(k: int, least: float):
    """The function of `nearest` on a block of vectors (id set) and one of queries (query_id set)."""

    def matrix(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors, such with a null component as zeros, as their cosine with anything is 0; norms summed in order."""
        x = t["v"].combine_chunks().flatten()
        m = x.to_numpy(zero_copy_only=False).astype(float).reshape(len(t), width)
        m[np.asarray(x.is_null()).reshape(len(t), width).any(1)] = 0.0
        return m, np.sqrt(sum((m[:, p] * m[:, p] for p in range(width)), np.zeros(len(m))))

    def meet(t: pa.Table) -> pa.Table:
        width = t["width"][0].as_py()
        own, asked = t.filter(t["id"].is_valid()), t.filter(t["query_id"].is_valid())
        own = own.take(pc.sort_indices(own["id"]))  # a lower row is a lower id
        out: list[pa.Table] = []
        if len(own) and len(asked):
            with np.errstate(all="ignore"):
                out = list(parts(own, asked, width))
        return pa.concat_tables(out) if out else pa.table({"query_id": t["query_id"].slice(0, 0), "id": t["id"].slice(0, 0), "sim": pa.array([], pa.float64())})

    def parts(own: pa.Table, asked: pa.Table, width: int):
        (every, norms), (qs, qnorms) = matrix(own, width), matrix(asked, width)
        # equal vectors stand for one another: of each, the lowest rows that k places and the query itself can use
        same = np.unique(np.ascontiguousarray(every).view(f"V{8 * width}").ravel(), return_inverse=True)[1] if width else np.zeros(len(every), np.int64)
        by = np.argsort(same, kind="stable")
        size = np.bincount(same)
        start = np.cumsum(size) - size
        repeats = pc.max(pc.value_counts(own["id"]).field("counts")).as_py()
        held = np.minimum(size, k + repeats)
        vs, ns = every[by[start]], norms[by[start]]
        odd, qodd = (~(n == 0) & ~((n > 1e-100) & (n < 1e100)) for n in (ns, qnorms))
        unit, qunit = (np.where((~o & (n > 0))[:, None], m / n[:, None], 0.0) for m, n, o in ((vs, ns, odd), (qs, qnorms, qodd)))
        near = 2e-9 + width * 1e-15
        step = max(1, 4_000_000 // len(vs))
        for a in range(0, len(qs), step):
            s = qunit[a : a + step] @ unit.T
            s[:, odd] = -np.inf
            low = np.partition(s, len(vs) - k - 1, axis=1)[:, len(vs) - k - 1] if len(vs) > k else np.full(len(s), -np.inf)
            hit = s >= np.maximum(low, least)[:, None] - near
            hit[:, odd] = True
            hit[qodd[a : a + step]] = True
            r, c = np.nonzero(hit)
            r += a
            both = ns[c] * qnorms[r]
            some = ~(ns[c] <= 0) & ~(qnorms[r] <= 0)
            sim = np.where(some, sum((vs[c, p] * qs[r, p] for p in range(width)), np.zeros(len(r))) / both, 0.0)
            yield from best(own, asked, np.repeat(r, held[c]), np.repeat(sim, held[c]), by[_runs(start[c], held[c])], near)

    def best(own: pa.Table, asked: pa.Table, r: np.ndarray, sim: np.ndarray, row: np.ndarray, near: float):
        """Of (query, sim, row) what can be among a query's k best: the first k of equal cosines, none beyond reach of the k-th."""
        other = pc.not_equal(own["id"].take(pa.array(row)), asked["query_id"].take(pa.array(r))).to_numpy()
        top = np.where(np.isnan(sim), np.inf, sim)  # as in Spark's order
        fit = other & (top >= least - near)
        r, sim, row, top = r[fit], sim[fit], row[fit], top[fit]
        o = np.lexsort((row, -top, r))
        r, sim, row, top = r[o], sim[o], row[o], top[o]
        if len(r):
            place = np.arange(len(r))
            new_q = np.r_[True, r[1:] != r[:-1]]
            new_run = new_q | np.r_[True, top[1:] != top[:-1]]
            first = np.maximum.accumulate(np.where(new_q, place, 0))
            last = np.minimum(first + k - 1, len(r) - 1)
            reach = np.where(r[last] == r, top[last], -np.inf)
            keep = (place - np.maximum.accumulate(np.where(new_run, place, 0)) < k) & (top >= reach - near)
            yield pa.table({"query_id": asked["query_id"].take(pa.array(r[keep])), "id": own["id"].take(pa.array(row[keep])), "sim": pa.array(sim[keep])})

    return meet


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each size, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def hash_sample(df: DataFrame, key: str, n: int, multiplier: int = 48271, modulus: int = 2147483647) -> DataFrame:
    """n rows in the order of a multiplicative hash: a sample that any engine can repeat."""
    return df.withColumn("h", (F.col(key) * multiplier + 11) % modulus).orderBy("h", key).limit(n)


def admit(sources: list[DataFrame], limit: int) -> DataFrame:
    """Union of ranked sources (id, pos) in order: an id belongs to the first that names it; `limit` ids in all.

    overlap counts the later sources that named it too.
    """
    every = None
    for k, s in enumerate(sources):
        s = s.select("id", "pos", F.lit(k).alias("source"))
        every = s if every is None else every.union(s)
    first = every.groupBy("id").agg(F.min(F.struct("source", "pos")).alias("m"), (F.count("*") - 1).alias("overlap"))
    order = W.orderBy("source", "pos", "id")
    out = first.select("id", F.col("m.source").alias("source"), F.col("m.pos").alias("pos"), "overlap")
    return out.orderBy("source", "pos", "id").limit(limit).withColumn("place", F.row_number().over(order))


def overlaps(work_tags: DataFrame, least: float, ratio: float) -> DataFrame:
    """Pairs of tags (small, large) that are variants of each other: intersection over the smaller set, sizes not too unlike."""
    df = doc_frequency(work_tags)
    p = tag_pairs(work_tags).join(df.select(F.col("tag").alias("a"), F.col("df").alias("na")), "a").join(df.select(F.col("tag").alias("b"), F.col("df").alias("nb")), "b")
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    p = p.withColumn("overlap", F.col("co") / small).where((F.col("overlap") > least) & (small / large >= ratio))
    a_small = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))
    return p.select(F.when(a_small, F.col("a")).otherwise(F.col("b")).alias("small"), F.when(a_small, F.col("b")).otherwise(F.col("a")).alias("large"), "overlap")


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)

"""Tag names, search, tag pages and point lookups: what a reader browses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators import corpus as op

#: Endings and qualifiers that mark a universe's tag, and those that mark another type of tag.
TAILS = [" - all media types", " - fandom", " (fandom)"]
QUALIFIERS = ["anime", "manga", "visual novel", "video game", "book", "movie", "tv show", "cartoon", "comics", "play", "podcast", "doujin", "anime & manga", "other media", "original work", "fandom", "tv", "cartoon/comics", "band", "musical", "novel", "cartoon & comics", "anime & manga & doujin", "book & movie"]
MEDIA = ["anime", "manga", "video game", "book", "movie", "tv show", "comics", "cartoon", "novel", "webcomic", "play", "podcast", "book & movie", "anime & manga", "original work"]
TYPES = ["freeform", "character", "relationship"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

# -- names -----------------------------------------------------------------------------------------------------------


def _low(name: Column) -> Column:
    return F.lower(F.trim(name))


def looks_like_universe(name: Column) -> Column:
    """Whether a name alone has the shape of a universe's tag: misses some, claims none wrongly."""
    n = _low(name)
    tail = reduce(lambda a, b: a | b, [n.endswith(t) for t in TAILS])
    return tail | F.regexp_extract(n, r"\(([^()]{1,60})\)$", 1).isin(QUALIFIERS)


def canonical(name: Column) -> Column:
    """A universe's name without its ending or qualifier."""
    n = _low(name)
    cut = F.trim(F.regexp_replace(n, r"\s*\([^()]{1,60}\)$", ""))
    out = F.when(cut != "", cut).otherwise(n)
    for t in reversed(TAILS):
        out = F.when(n.endswith(t), F.trim(n.substr(F.lit(1), F.length(n) - F.lit(len(t))))).otherwise(out)
    return out


def group_key(names: Column) -> Column:
    """The first universe of a work's tags; null where none has the shape."""
    return F.get(F.transform(F.filter(names, looks_like_universe), canonical), 0)


def bases(names: DataFrame) -> DataFrame:
    """(base) of every name that ends canonically. names: (tag)."""
    b = F.regexp_extract(_low(F.col("tag")), r"^(.*) - (?:all media types|fandom)$", 1)
    return names.select(F.trim(b).alias("base")).where("base <> ''").distinct()


def by_shape(names: DataFrame) -> DataFrame:
    """(tag, universe, base): whether a name is a universe's by its shape or, for "x - somebody", because x is a base elsewhere."""
    n = _low(F.col("tag"))
    left, right = F.trim(F.regexp_extract(n, r"^(.+) - (.*)$", 1)), F.trim(F.regexp_extract(n, r"^(.+) - (.*)$", 2))
    medium = F.trim(F.regexp_extract(n, r"^.+ \((.*)\)$", 1)).isin(MEDIA)
    rows = names.select("tag", left.alias("left"), right.alias("right"), medium.alias("medium"), F.trim(F.regexp_extract(n, r"^(.+) \(.*\)$", 1)).alias("plain"))
    rows = rows.join(bases(names).select(F.col("base").alias("left"), F.lit(True).alias("known")), "left", "left")
    ends, split = F.col("right").isin("all media types", "fandom"), F.col("left") != ""
    universe = F.when(split, ends | (~F.col("right").isin(TYPES) & F.coalesce("known", F.lit(False)))).otherwise(F.col("medium"))
    base = F.when(split & (ends | F.coalesce("known", F.lit(False))), F.col("left")).when(F.col("medium"), F.col("plain")).otherwise("")
    return rows.select("tag", universe.alias("universe"), base.alias("base"))


def title_key(title: Column) -> Column:
    """A title for matching: a marker in brackets at the start and what follows a closed bracket cut, letters and digits only."""
    n = F.lower(title)
    marked = F.regexp_extract(n, r"^[\[(][^\])]*[\])] *(.+)$", 1)
    n = F.when(marked != "", marked).otherwise(n)
    cut = F.regexp_extract(n, r"^(.[^\[(]*)[\[(].*[\])]", 1)
    n = F.when(cut != "", cut).otherwise(n)
    return F.trim(F.regexp_replace(n, "[^a-z0-9]+", " "))


def author_keys(byline: Column) -> Column:
    """All spellings of a byline worth matching: the name, the one in parentheses, every part between commas."""
    s = F.trim(byline)
    named = F.array(title_key(F.trim(F.regexp_extract(s, r"^(.[^(]*)\(", 1))), title_key(F.regexp_extract(s, r"^.[^(]*\(([^)]*)\)", 1)))
    parts = F.transform(F.split(s, ","), lambda p: title_key(F.regexp_replace(F.trim(p), r"^(.[^(]*)\(.*$", "$1")))
    return F.array_distinct(F.filter(F.concat(named, parts), lambda k: k != ""))


def label_words(name: Column) -> Column:
    """Lower-case words of three characters or more without punctuation at their ends."""
    words = F.transform(F.split(F.lower(name), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(words, lambda w: F.length(w) >= 3)


def short_label(name: Column, most: int = 26) -> Column:
    """A name cut at the last blank within `most` characters."""
    cut = F.regexp_extract(F.substring(name, 1, most), r"^(.*)\s", 1)
    return F.when(F.length(name) <= most, name).otherwise(F.when(cut != "", cut).otherwise(F.substring(name, 1, most)))


def month_of(s: Column) -> Column:
    """1..12 from a number, a month's name or its first three letters or more; else null."""
    n = _low(s)
    named = F.coalesce(*(F.when((F.length(n) >= 3) & F.lit(m).startswith(n), F.lit(k + 1)) for k, m in enumerate(MONTHS)))
    number = n.try_cast("int")
    return F.coalesce(F.when(number.between(1, 12), number), named)


def chapters_complete(fraction: Column) -> Column:
    """Whether n/m has equal sides."""
    p = F.split(fraction, "/")
    return F.coalesce((F.size(p) == 2) & (F.trim(F.get(p, 0)) == F.trim(F.get(p, 1))) & (F.trim(F.get(p, 0)) != ""), F.lit(False))


def work_id_of(url: Column) -> Column:
    """The number behind /works/ (or /page/) in an address; 0 where there is none."""
    return F.coalesce(F.regexp_extract(url, r"/(?:works|page)/(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


# -- pages -----------------------------------------------------------------------------------------------------------


def tag_search(work_tags: DataFrame, text: str) -> DataFrame:
    """(tag, works) of the tags that hold a text, whatever its case, by name."""
    return op.doc_frequency(work_tags).where(F.contains(F.lower("tag"), F.lit(text.lower()))).orderBy("tag").select("tag", F.col("df").alias("works"))


def tag_page(works: DataFrame, work_tags: DataFrame, tag: str, complete: str = "any", language: str = "") -> DataFrame:
    """A tag's works under the page's filters; complete: any, complete or wip, or a synonym of these."""
    state = {"": None, "any": None, "all": None, "complete": True, "completed": True, "yes": True, "true": True, "wip": False, "incomplete": False, "no": False, "false": False}
    if complete.strip().lower() not in state:
        raise ValueError(f"complete is any, complete or wip, not {complete!r}")
    wanted = state[complete.strip().lower()]
    mine = op.carried(work_tags).where(F.col("tag") == tag).select(F.col("work_id").alias("id"))
    out = works.join(mine, "id", "left_semi")
    out = out if wanted is None else out.where(F.col("complete") == wanted)
    return out.where(F.lower("language") == language.lower()) if language else out


def page_totals(works: DataFrame, work_tags: DataFrame, complete: str = "complete") -> DataFrame:
    """(tag, works, shown): distinct works of every tag, and those a filter leaves."""
    w = works.select(F.col("id").alias("work_id"), "complete")
    shown = F.col("complete") if complete == "complete" else ~F.col("complete")
    return op.carried(work_tags).join(w, "work_id").groupBy("tag").agg(F.countDistinct("work_id").alias("works"), F.countDistinct(F.when(shown, F.col("work_id"))).alias("shown"))


def slim_lookup(works: DataFrame, work_tags: DataFrame, ids: DataFrame) -> DataFrame:
    """The works of an id list (id; repeats count once) with their tags in order; unknown ids give none."""
    w = works.join(ids.select("id").distinct(), "id", "left_semi")
    t = work_tags.join(ids.select(F.col("id").alias("work_id")).distinct(), "work_id", "left_semi").groupBy(F.col("work_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return w.join(t, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def taste_blend(works: DataFrame, work_tags: DataFrame, tag: str, taste: DataFrame, limit: int) -> DataFrame:
    """(id, kind, place): the tag's works by kudos and works without the tag by taste (id, score), taking turns."""
    mine = op.carried(work_tags).where(F.col("tag") == tag).select(F.col("work_id").alias("id"))
    own = op.top_by(works.join(mine, "id", "left_semi"), "kudos", limit).select("id", F.lit("tagged").alias("kind"), F.col("kudos").cast("double").alias("v"))
    new = taste.join(mine, "id", "left_anti").orderBy(F.desc("score"), "id").limit(limit).select("id", F.lit("taste").alias("kind"), F.col("score").cast("double").alias("v"))
    turn = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("v"), "id"))
    both = own.union(new).withColumn("turn", turn)
    return both.withColumn("place", F.row_number().over(W.orderBy("turn", F.desc("kind")))).where(F.col("place") <= limit).select("id", "kind", "place")


def first_seen_names(tags: DataFrame) -> DataFrame:
    """(name, id): the smallest id of every name, whatever its case."""
    return tags.groupBy(_low(F.col("tag")).alias("name")).agg(F.min("id").alias("id"))


def universe_check(declared: DataFrame, names: DataFrame) -> DataFrame:
    """(tag, state) of a family's declared names: missing, explicit (present and declared so), present, or not a universe."""
    known = by_shape(names.select("tag").distinct()).select(_low(F.col("tag")).alias("key"), "universe")
    rows = declared.withColumn("key", _low(F.col("tag"))).join(known.groupBy("key").agg(F.max("universe").alias("universe")), "key", "left")
    state = F.when(F.col("universe").isNull(), "missing").when(F.col("explicit"), "explicit").when(F.col("universe"), "present").otherwise("not a universe")
    return rows.select("tag", state.alias("state"))


def merged_authors(pairs: DataFrame, tagged: DataFrame, limit: int) -> DataFrame:
    """Similar authors of two lists (author, readers) and (author, score): readers in common first, tags alone after."""
    both = pairs.join(tagged, "author", "full_outer")
    return both.orderBy(F.col("readers").desc_nulls_last(), F.col("score").desc_nulls_last(), "author").limit(limit).select("author", "readers", "score")


def co_readers_from(works: DataFrame, interactions: DataFrame, authors: DataFrame, limit: int) -> DataFrame:
    """Other authors by how many readers of any of the given ones (author) they have, each reader once."""
    r = op.reads(interactions).join(works.select(F.col("id").alias("work_id"), F.lower("authors").alias("author")), "work_id").select("user_id", "author").distinct()
    readers = r.join(authors, "author", "left_semi").select("user_id").distinct()
    out = r.join(readers, "user_id", "left_semi").join(authors, "author", "left_anti").groupBy("author").agg(F.count("*").alias("readers"))
    return out.orderBy(F.desc("readers"), "author").limit(limit)


def shelf_authors(scored: DataFrame, universes: DataFrame, limit: int) -> DataFrame:
    """(author, works, score, universes): a shelf's works (id, authors, score) by author, with three universes at most."""
    a = scored.select("id", F.explode(F.split("authors", ",")).alias("author"), "score").withColumn("author", F.trim("author"))
    per = a.groupBy("author").agg(F.count("*").alias("works"), F.sum("score").alias("score"))
    u = a.join(universes, "id").groupBy("author").agg(F.slice(F.array_sort(F.collect_set("universe")), 1, 3).alias("universes"))
    return per.join(u, "author", "left").orderBy(F.desc(F.round("score", 9)), "author").limit(limit)

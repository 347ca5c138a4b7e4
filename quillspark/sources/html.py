"""HTML extraction as column expressions: links, text, records; and the snapshot sink's shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.hashing import fnv_bucket

#: The named character references that are decoded.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def hrefs(html: Column) -> Column:
    """Distinct link targets in page order, fragments cut."""
    raw = F.regexp_extract_all(html, F.lit(r'(?i)href="([^"#]*)'), F.lit(1))
    return F.array_distinct(F.filter(raw, lambda h: h != ""))


def resolved(href: Column, page_url: Column) -> Column:
    """Absolute address of a link on a page; null where it isn't http."""
    root = F.regexp_extract(page_url, r"^(https?://[^/]+)", 1)
    folder = F.regexp_extract(page_url, r"^(https?://[^?#]*/)", 1)
    return F.when(href.rlike("^https?://"), href).when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).when(F.startswith(href, F.lit("/")), F.concat(root, href)).when(~href.rlike("^[a-z]+:"), F.concat(folder, href))


def same_host_links(pages: DataFrame, id_col: str, url: str, html: str) -> DataFrame:
    """(id, link): absolute links to a page's own host."""
    host = lambda c: F.regexp_extract(c, r"^https?://([^/?#]+)", 1)
    out = pages.select(F.col(id_col), F.col(url).alias("_u"), F.explode(hrefs(F.col(html))).alias("h")).select(id_col, "_u", resolved(F.col("h"), F.col("_u")).alias("link"))
    return out.where((F.col("link").isNotNull()) & (host(F.col("link")) == host(F.col("_u")))).select(id_col, "link").distinct()


def stripped(html: Column) -> Column:
    """Text of a page: scripts and styles out, tags to blanks, named references decoded, white space collapsed."""
    s = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    s = F.regexp_replace(s, r"<[^>]*>", " ")
    for name, char in ENTITIES:
        s = F.replace(s, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(s, r"[ \t\r\n]+", " "))


def title_of(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1))


def next_page(html: Column) -> Column:
    """Target of the rel=next link, attributes in either order; null without one."""
    a = F.regexp_extract(html, r'(?i)<a[^>]*rel="next"[^>]*href="([^"]*)"', 1)
    b = F.regexp_extract(html, r'(?i)<a[^>]*href="([^"]*)"[^>]*rel="next"', 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def numbers_of(s: Column) -> Column:
    """A count with thousands separators; null where there is none."""
    return F.try_cast(F.regexp_replace(s, ",", ""), "long") if hasattr(F, "try_cast") else F.regexp_replace(s, ",", "").try_cast("long")


def is_interstitial(html: Column) -> Column:
    return html.rlike(r"(?i)(just a moment|checking your browser|enable javascript and cookies)")


def listing(html: Column, item: str) -> Column:
    """A listing page's items: the pieces that begin with the item's opening tag."""
    return F.filter(F.split(html, f"(?={item})"), lambda p: p.rlike(f"^{item}"))


def unescaped(s: Column) -> Column:
    """The five named entities and the numeric apostrophe as the characters they stand for."""
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(c))
    return s


def bookmarks(html: Column) -> Column:
    """array<(bookmark, work, title, shown, readers)> of a bookmarks page; the work is the one its class names, items without are left out."""
    first = lambda p, r: F.regexp_extract(p, r, 1)
    item = lambda p: F.struct(
        first(p, r'^<li\s+id="bookmark_(\d+)"').cast("long").alias("bookmark"),
        first(F.substring(p, 1, 400), r"\bwork-(\d+)\b").try_cast("long").alias("work"),
        unescaped(F.trim(first(p, r'(?s)<a[^>]*href="/works/\d+"[^>]*>([^<]*)</a>'))).alias("title"),
        F.trim(first(p, r'(?is)<p[^>]*class="datetime"[^>]*>([^<]*)</p>')).alias("shown"),
        numbers_of(F.nullif(first(p, r'(?s)<p[^>]*class="status"[^>]*title="([\d,]+) Bookmarks?"'), F.lit(""))).alias("readers"),
    )
    return F.filter(F.transform(listing(html, r'<li\s+id="bookmark_\d+"[^>]*class="[^"]*bookmark blurb'), item), lambda b: b["work"].isNotNull())


def universe_links(html: Column) -> Column:
    """array<(name, path, works)> of a catalogue page; a path is a tag's plain text, without entities and percent signs."""
    link = r'<a[^>]*href="/tags/([^"/]+)/works"[^>]*>([^<]*)</a>\s*\(([\d,]+)\)'
    all_ = lambda n: F.regexp_extract_all(html, F.lit(link), F.lit(n))
    path = lambda p: F.coalesce(F.try_url_decode(F.replace(unescaped(p), F.lit("+"), F.lit("%2B"))), unescaped(p))
    rows = F.transform(F.arrays_zip(all_(1).alias("p"), all_(2).alias("n"), all_(3).alias("w")), lambda x: F.struct(unescaped(F.trim(x["n"])).alias("name"), path(x["p"]).alias("path"), numbers_of(x["w"]).alias("works")))
    return F.filter(rows, lambda x: x["name"] != "")


def shard_table(df: DataFrame, key: str, shards: int = 256) -> DataFrame:
    """(shard, rows, digest, body): a snapshot's JSON shards by key hash, rows sorted, with SHA-256."""
    row = F.to_json(F.struct(*df.columns))
    s = df.select(fnv_bucket(F.col(key).cast("string"), shards).alias("shard"), row.alias("row"))
    s = s.groupBy("shard").agg(F.count("*").alias("rows"), F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("row")), ","), F.lit("]")).alias("body"))
    return s.select("shard", "rows", F.sha2("body", 256).alias("digest"), "body")


def verified(shards: DataFrame, manifest: DataFrame) -> DataFrame:
    """Shards of the manifest (shard, digest) that are missing or whose body has another digest."""
    return manifest.join(shards.select("shard", F.sha2("body", 256).alias("digest")), ["shard", "digest"], "left_anti")


def pseudonym(user: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), user.cast("string")), 256), 1, 32)


def frontier(start: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """(node, depth): breadth-first walk over (src, dst) from start (node), each node at its least depth."""
    seen = start.select("node", F.lit(0).alias("depth")).distinct()
    front = seen
    for k in range(1, depth + 1):
        front = links.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").select("node", F.lit(k).alias("depth"))
        seen = seen.union(front)
    return seen


def quota_plan(groups: DataFrame, target: int, floor: int, cap: int) -> DataFrame:
    """(name, works, quota): a floor for every group and the rest by the root of its size, at most its size and the cap."""
    t = groups.agg(F.sum(F.sqrt("works")).alias("roots"), F.count("*").alias("n"))
    rest = F.greatest(F.lit(0), target - floor * F.col("n"))
    share = floor + F.floor(rest * F.round(F.sqrt("works") / F.col("roots"), 12))
    return groups.join(F.broadcast(t)).select("name", "works", F.least(share, F.col("works"), F.lit(cap)).cast("long").alias("quota"))

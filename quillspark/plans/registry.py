"""Registration of queries with their SQL twins, and the shared table expressions of the twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: Table expressions for the roles, as the catalog binding makes them.
CTES = {
    "sold": "sold AS (SELECT l_partkey, l_quantity, o_custkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "works": """works AS (SELECT p_partkey::BIGINT AS id, p_name AS title, p_brand AS authors, p_size::BIGINT * 1000 AS word_count, p_type AS rating,
        coalesce(q, 0)::BIGINT AS kudos, coalesce(n, 0)::BIGINT AS hits, b AS bookmarks, p_size % 3 <> 0 AS complete, d::DATE AS update_date,
        CASE WHEN p_size % 8 < 5 THEN 'English' WHEN p_size % 8 < 7 THEN 'French' ELSE 'German' END AS language
        FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q, count(*) AS n, count(DISTINCT o_custkey) AS b, max(o_orderdate) AS d FROM sold GROUP BY 1) ON p_partkey = l_partkey)""",
    "work_tags": """work_tags AS (SELECT DISTINCT * FROM (
        SELECT p_partkey::BIGINT AS work_id, unnest(string_split(p_name, ' ')) AS tag, 'name' AS tag_type FROM part
        UNION ALL SELECT p_partkey, p_brand, 'brand' FROM part UNION ALL SELECT p_partkey, p_type, 'type' FROM part
        UNION ALL SELECT p_partkey, 'size ' || p_size, 'size' FROM part))""",
    "interactions": "interactions AS (SELECT o_custkey AS user_id, l_partkey::BIGINT AS work_id FROM sold)",
    "reads": "reads AS (SELECT DISTINCT user_id, work_id FROM interactions)",
    "carried": "carried AS (SELECT DISTINCT work_id, tag FROM work_tags)",
    "df": "df AS (SELECT tag, count(*) AS df FROM carried GROUP BY 1)",
    "total": "total AS (SELECT count(*) AS n FROM works)",
    "pairs": "pairs AS (SELECT a.tag AS a, b.tag AS b, count(*) AS co FROM carried a JOIN carried b ON a.work_id = b.work_id AND a.tag < b.tag GROUP BY 1, 2)",
    "sym": "sym AS (SELECT a AS src, b AS dst, co FROM pairs UNION ALL SELECT b, a, co FROM pairs)",
    "seeds": "seeds AS (SELECT id AS seed FROM works ORDER BY kudos DESC, id LIMIT 3)",
    "evt": "evt AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)",
}
NEEDS = {"works": ["sold"], "interactions": ["sold"], "reads": ["interactions"], "carried": ["work_tags"], "df": ["carried"], "total": ["works"], "pairs": ["carried"], "sym": ["pairs"], "seeds": ["works"]}


def ctes(*names: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, ()):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return ",\n".join(CTES[n] for n in order)


def query(sql: str | None = None, uses: str = ""):
    """Register a function as a query under its own name; uses: shared table expressions of its SQL."""

    def register(f: Callable) -> Callable:
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql:
            head = ctes(*uses.split())
            body = sql.strip()
            if head and body[:5].upper() == "WITH ":
                SQL[name] = f"WITH {head},\n{body[5:]}"
            elif body.startswith(","):
                SQL[name] = f"WITH {head}\n{body}"
            else:
                SQL[name] = f"WITH {head}\n{body}" if head else body
        return f

    return register

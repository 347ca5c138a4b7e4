"""Rated lists pasted from a book manager's fixed-width listing."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame

ENTRY = "book long, rating long, rated boolean, title string, author string, alt_title string, alt_author string"
ROW = re.compile(rb"(\d+) (.*)", re.S)
RATING = re.compile(rb" *(\d+)")
NONE = re.compile(rb" *none", re.I)
GAP = re.compile(rb" {2,}")


def _fields(line: bytes, rest: bytes) -> tuple[int, bool, bytes, bytes, int]:
    """(rating, whether there is one, title, author, the author's column) of a row behind its number."""
    number, none = RATING.match(rest), NONE.match(rest)
    rated = bool(number) and int(number[1]) <= 10
    body = rest[number.end() :] if rated else rest[none.end() :] if none else rest.lstrip(b" ")
    gaps = list(GAP.finditer(body))
    if not gaps:
        return int(number[1]) if rated else 0, rated, body.strip(), b"", 0
    last = gaps[-1]
    return int(number[1]) if rated else 0, rated, body[: last.start()].strip(), body[last.end() :].strip(), last.end() + len(line) - len(body)


def entries(text: str | None) -> list[tuple]:
    """A paste's rows as ENTRY. Lines that don't begin with a number go on with the row above, with its author where they are indented
    to the column most authors start in (two at least), else with its title: glued, and for the first such line also joined by a
    blank (alt). A blank line ends a row. Without a heading that names title and authors there are none.
    """
    lines = [x.rstrip(b" \t\r") for x in (text or "").encode().split(b"\n")]
    head = next((i for i, x in enumerate(lines) if x.lower().startswith(b"id") and b"title" in x.lower() and b"authors" in x.lower()), len(lines))
    found, columns, open_ = [], Counter(), False
    for line in lines[head + 1 :]:
        start = ROW.match(line)
        if start:
            rating, rated, title, author, column = _fields(line, start[2])
            if column:
                columns[column] += 1
            found.append((int(start[1]), rating, rated, title, author, []))
        elif line.strip() and open_:
            found[-1][5].append(line)
        open_ = bool(start) or open_ and bool(line.strip())
    column, seen = min(columns.items(), key=lambda c: (-c[1], c[0]), default=(0, 0))
    out = []
    for book, rating, rated, title, author, more in found:
        text_of, alt = {"title": title, "author": author}, {"title": b"", "author": b""}
        for line in more:
            field = "author" if seen > 1 and len(line) - len(line.lstrip(b" ")) >= column else "title"
            piece = line.strip()
            alt[field] = alt[field] or b" ".join(filter(None, (text_of[field], piece)))
            text_of[field] += piece
        out.append((book, rating, rated, *(x.decode(errors="replace") for x in (text_of["title"], text_of["author"], alt["title"], alt["author"]))))
    return out


def rated_lists(pastes: DataFrame) -> DataFrame:
    """(paste, *ENTRY) of whole pasted texts (paste long, text); a text is one reader's list."""

    def run(batches):
        for b in batches:
            rows = [(p, *e) for p, t in zip(b["paste"], b["text"]) for e in entries(t)]
            yield pd.DataFrame(rows, columns=["paste", *(f.split()[0] for f in ENTRY.split(", "))])

    return pastes.select("paste", "text").mapInPandas(run, "paste long, " + ENTRY)

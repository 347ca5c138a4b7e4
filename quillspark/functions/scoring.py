"""Column expressions: dates, text keys, information measures and engagement scores.

A null result means "no opinion" and is never the same as zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning of their own in a summary.
STOPWORDS = """
about after again against almost along already also although always among another anything around because been before being
below between both bring cannot could didnt does doesn doing done down during each else even ever every everything except feel
feels felt find first found from further gave give given goes going gone good great had have having here herself himself
however into itself just keep kept know known last later least less like likely little long look looking made make makes many
maybe mean means might more most much must myself need never next none nothing often once only other others otherwise ought
over perhaps please quite rather really right said same says seem seems seen several shall should since some something
sometimes soon still such take taken takes than that their theirs them themselves then there these they thing things think
this those though through thus together took toward towards under until upon used uses very want wanted wants well went were
what whatever when where whether which while whom whose will with within without would your yours yourself
chapter chapters summary spoilers warning warnings work story fic fics notes note author update updates series part complete
ongoing
""".split()


def parsed_date(s: Column) -> Column:
    """RFC3339, 'Y-m-d H:M:S', 'Y-m-d' and 'd Mon Y'; null where none fits (unknown, not old)."""
    iso = F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})", 1)
    shown = F.regexp_extract(s, r"^(\d{1,2} [A-Z][a-z]{2} \d{4})$", 1)
    return F.coalesce(F.try_to_date(F.when(iso != "", iso), "yyyy-MM-dd"), F.try_to_date(F.when(shown != "", shown), "d MMM yyyy"))


def epoch_days(s: Column) -> Column:
    return F.coalesce(F.date_diff(parsed_date(s), F.lit("1970-01-01").cast("date")), F.lit(0))


def year_of(s: Column) -> Column:
    y = F.regexp_extract(s, r"^(\d{4})-|(\d{4})$", 0)
    return F.when(y != "", F.regexp_extract(y, r"\d{4}", 0).cast("int"))


def author_key(a: Column) -> Column:
    """Lower case, single blanks, a trailing parenthesis dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(a), r"\s*\([^(]*\)$", ""), r"\s+", " "))


def authors_of(byline: Column) -> Column:
    return F.filter(F.transform(F.split(byline, ","), lambda x: F.trim(x)), lambda x: x != "")


def summary_terms(text: Column) -> Column:
    """Distinct lower-case letter runs of 4 to 24 characters that are no stop words."""
    return F.array_except(summary_words(text), F.array(*(F.lit(w) for w in STOPWORDS)))


def summary_words(text: Column) -> Column:
    """The same with stop words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?<!\p{L})\p{L}{4,24}+(?!\p{L})"), F.lit(0)))


def pmi(co: Column, fa: Column, fb: Column, n: Column) -> Column:
    return F.when((co > 0) & (fa > 0) & (fb > 0) & (n > 0), F.log(co * n / (fa * fb))).otherwise(0.0)


def npmi(co: Column, fa: Column, fb: Column, n: Column) -> Column:
    p = co / n
    return F.when(p >= 1, 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), pmi(co, fa, fb, n) / -F.log(p))))


def idf(df: Column, n: Column) -> Column:
    """ln(N/df); unknown counts as one occurrence, everywhere as none."""
    return F.when(df.isNull() | (df <= 0), F.log(n)).when(df >= n, 0.0).otherwise(F.log(n / df))


def quality(kudos: Column, words: Column) -> Column:
    return F.when((kudos > 0) & (words >= 1000), F.least(F.lit(1.0), F.log1p(kudos / (words / 1000.0)) / F.log(F.lit(501.0))))


def popularity(hits: Column, kudos: Column) -> Column:
    h = 0.6 * F.log1p(hits) / F.log1p(F.lit(1e6))
    k = 0.4 * F.log1p(kudos) / F.log1p(F.lit(1e5))
    return F.least(F.lit(1.0), h + k)


def recency(updated: Column, as_of: Column) -> Column:
    age = F.greatest(F.lit(0), F.date_diff(as_of, updated))
    return F.when(updated.isNotNull(), F.pow(F.lit(2.0), -age / 365.0))


def length_fit(words: Column, median: Column) -> Column:
    return F.when((words > 0) & (median > 0), F.least(words, median) / F.greatest(words, median))


def browse_score(kudos: Column, age_days: Column) -> Column:
    return F.log10(kudos + 1) / F.sqrt(age_days + 1)


def rarity(p: Column) -> Column:
    return F.least(F.lit(1.0), -F.log10(p) / 4)


def decade_weight(v: Column) -> Column:
    """Engagement weight: divisions by ten until one or less is left, four at most, plus what is left less one, over four."""
    v = v.cast("double")
    decades = F.least(F.lit(4.0), F.greatest(F.lit(0.0), F.ceil(F.round(F.log10(F.greatest(v, F.lit(1.0))), 12))))
    rest = v / F.pow(F.lit(10.0), decades)
    return F.when(v > 0, (decades + rest - 1) / 4).otherwise(0.05)


def cosine(a: Column, b: Column) -> Column:
    """Zero where a side has no magnitude."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def effective_rating(mu: Column, phi: Column, median: Column) -> Column:
    return median + (mu - median) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - phi / 350))


def influence(agree: Column) -> Column:
    return F.when(agree <= 0, 0.0).otherwise(agree * agree)

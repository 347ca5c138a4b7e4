"""Pasted lists: wrapped fields, ratings, texts that are none."""

from quillspark.sources.paste import entries, rated_lists

LIST = """calibre list
id  *rating  title                 authors
12  10       A long title that     Ann Author
             goes on               
14  None     Second               
20  7        Third    part         Bob
                                   & Cy
                                   & Di
21  11 oclock                      Ed

             stray
22 x
"""


def test_wrapped_fields_and_ratings():
    got = entries(LIST)
    assert got[0] == (12, 10, True, "A long title thatgoes on", "Ann Author", "A long title that goes on", "")
    assert got[1] == (14, 0, False, "", "Second", "", "")  # the gap before a lone title makes it an author, as in the original
    assert got[2] == (20, 7, True, "Third    part", "Bob& Cy& Di", "", "Bob & Cy")
    assert got[3] == (21, 0, False, "11 oclock", "Ed", "", "") and got[4] == (22, 0, False, "x", "", "", "") and len(got) == 5


def test_texts_that_are_no_list(spark):
    assert entries(None) == entries("") == entries("12 7  A  B") == entries("id title authors") == []
    df = spark.createDataFrame([(1, LIST), (2, None), (3, "none")], "paste long, text string")
    assert [(r["paste"], r["book"]) for r in rated_lists(df).collect()] == [(1, i) for i in (12, 14, 20, 21, 22)]
    assert rated_lists(df.limit(0)).count() == 0
    assert entries("id title authors\n1 3  été ’  雪")[0][3:5] == ("été ’", "雪")

import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Nulls, empty and odd texts, ties, repeated rows, and a column whose name operators use themselves.
ROWS = [
    (0, "The quick brown fox jumps over the lazy dog. It was not amused by that at all.\nSecond line here.", "en", "a", 7),
    (1, "The quick brown fox jumps over the lazy dog. It was not amused by that at all.\nSecond line here.", "en", "a", 7),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, "   \n\t ", "de", "b", 5),
    (5, "x", "en", None, 1),
    (6, "Released under the MIT License, not the Apache license. GNU General\tPublic LICENSE!", "en", "b", 80),
    (7, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich. Und noch ein Satz.", "de", "c", 80),
    (8, " ".join(f"w{i}" for i in range(120)), "en", "c", 0),
    (9, " ".join(f"w{i}" for i in range(20, 100)) + " tail", "en", "c", 0),
    (10, "la la " * 200, "fr", "c", 0),
    (10, "la la " * 200, "fr", "c", 0),
    (None, "no id but a text of some words", "en", "a", 0),
    (12, "日本語 テキスト 😀 " * 30, "ja", "d", 0),
    (13, " ".join(f"w{i}" for i in range(120)) + " one more", "en", "c", 0),
]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """A table of hard cases, as files, with extra columns whose names clash with those of the operators."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    frame.selectExpr("*", "'z' AS row", "1 AS key", "2.5 AS hash", "'q' AS node", "0 AS size").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)

"""Duplicates, markdown, evaluation, usage and file profiles against values worked out by hand."""

from __future__ import annotations

from corpuskit.operators import analytics, fusion, preparation
from corpuskit.sources import files


def test_duplicate_captures(spark):
    rows = [(1, "a", 5, False), (2, "a", 3, False), (3, "a", 1, True), (4, "b", 1, False), (5, None, 2, False), (6, "", 9, False)]
    got = preparation.duplicate_captures(spark.createDataFrame(rows, "id long, text string, captured_s long, deleted boolean"))
    assert sorted(map(tuple, got.collect())) == [(1, 2, 5), (6, 5, 9)]


def test_markdown_docs(spark):
    texts = [
        '---\ntitle: "The title"\ntag: x\n---\n# Head\nSome **bold** [words](http://x.y).\n',
        "plain\n\n## Second\n```\n# not a heading\n```\n- one\n- two",
        "\n  only a line\nmore",
        "",
        None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r for r in preparation.markdown_docs(docs).collect()}
    assert (got[0].title, got[0].plain, got[0].n_words, got[0].n_headings) == ("The title", "Head\nSome bold words.", 4, 1)
    assert (got[1].title, got[1].n_headings) == ("Second", 1)
    assert got[1].plain.split() == ["plain", "Second", "not", "a", "heading", "one", "two"]
    assert (got[2].title, got[2].n_words) == ("only a line", 4)
    assert [(got[i].title, got[i].plain, got[i].n_words) for i in (3, 4)] == [(None, "", 0)] * 2


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 5), (2, 20, 4), (2, 21, 1)], "query_id long, id long, pos int")
    judged = spark.createDataFrame([(1, 10, "expected"), (1, 12, "acceptable"), (1, 11, "after"), (2, 20, "expected"), (2, 21, "after"), (3, 30, "expected")], "query_id long, id long, role string")
    one = fusion.evaluate(hits, judged.filter("role = 'expected'"))
    totals = fusion.evaluation_totals(one).first()
    assert (totals.queries, totals.hits) == (3, 1) and abs(totals.recall - 1 / 3) < 1e-12 and abs(totals.mrr - 1.25 / 3) < 1e-12
    assert sorted(map(tuple, fusion.acceptable_hits(hits, judged).collect())) == [(1, 1, True), (2, 0, False), (3, 0, False)]
    assert tuple(fusion.evaluation_totals(one.limit(0)).first()) == (0, 0, None, None)


def test_run_usage(spark):
    rows = [(1, "a", 10, 1, 100), (1, "a", 20, None, 300), (1, "b", 1, 1, None)]
    got = analytics.run_usage(spark.createDataFrame(rows, "run_id long, task string, prompt long, completion long, latency_ms long"))
    assert sorted(map(tuple, got.collect())) == [(1, "a", 2, 30, 1, 400, 200.0, 280.0), (1, "b", 1, 1, 1, 0, None, None)]


def test_quoted_cells(spark):
    got = files.profile_delimited(spark.createDataFrame([("p", 'a,"b, c",d\n,"x ""y"", z",3\n1,2\n'), ("q", "a|b\n1|2")], "path string, text string"))
    p, q = sorted(got.collect(), key=lambda r: r.path)
    assert (p.delimiter, list(p.columns), p.n_rows) == (",", ["a", "b, c", "d"], 2)
    assert list(p.preview) == ['a:  · b, c: x "y", z · d: 3', "a: 1 · b, c: 2 · d: "]
    assert list(q.preview) == ["a: 1 · b: 2"]


def test_folders_and_entries(spark):
    rows = [("r", "a.py", 1), ("r", "d/e/b.py", 2), ("r", "d/c.md", 3), ("s", "x", 1)]
    got = {r.root: r for r in files.folder_manifest(spark.createDataFrame(rows, "root string, rel string, size long")).collect()}
    assert (got["r"].n_files, got["r"].n_dirs, list(got["r"].entries)) == (3, 2, ["a.py", "d/"])
    assert (got["s"].n_dirs, list(got["s"].entries)) == (0, ["x"])

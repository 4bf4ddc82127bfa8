"""Operators whose rules SQL does not express, on small inputs worked out by hand."""

from __future__ import annotations

import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.operators import collections, lexical, pages, preparation, records, vectors
from corpuskit.sources import tables
from corpuskit.streaming import streams


def test_links(spark):
    table = {
        "https://www.Example.com/Path/?utm_source=x&b=2&a=1#frag": "https://example.com/Path?a=1&b=2",
        "https://youtu.be/abc123?si=share": "https://youtube.com/watch?v=abc123",
        "https://m.youtube.com/watch?v=abc123&list=PL1&t=42": "https://youtube.com/watch?v=abc123",
        "https://www.youtube.com/shorts/xyz": "https://youtube.com/watch?v=xyz",
        "https://x.com/someone/status/1?s=20&t=abc": "https://twitter.com/someone/status/1",
        "https://mobile.twitter.com/a/status/2": "https://twitter.com/a/status/2",
        "https://example.com/a//b/index.html": "https://example.com/a/b",
        "http://example.com:80/page?fbclid=1&gclid=2&ref=hn": "https://example.com/page",
        "https://app.example.com/#/settings/keys": "https://app.example.com#/settings/keys",
        "https://old.reddit.com/r/x/comments/1/t/?context=3": "https://reddit.com/r/x/comments/1/t",
        "https://en.m.wikipedia.org/wiki/RAG": "https://en.wikipedia.org/wiki/RAG",
        "https://blog.example.com/post?id=7&utm_medium=email&refund_id=3&yclid=4": "https://blog.example.com/post?id=7&refund_id=3",
        "mailto:a@b.c": None,
        "https://": None,
    }
    rows = spark.createDataFrame(list(table.items()), "url string, want string").select("url", "want", preparation.canonical_url(F.col("url")).alias("got")).collect()
    assert [(r.url, r.got) for r in rows] == [(r.url, r.want) for r in rows]


def test_edges_depend_on_what_was_accepted(spark):
    plan = [(1, 1, 10, 11, 0.9), (1, 2, 11, 10, 0.8), (1, 3, 10, 10, 0.9), (1, 4, 10, 99, 0.9), (1, 5, 20, 21, 0.9), (1, 6, 10, 12, 0.5), (1, 7, 10, 13, 0.9), (1, 8, 10, 14, 0.9), *((1, 20 + i, 10, 30 + i, 0.7) for i in range(6)), (2, 1, 10, 11, 0.9)]
    scope = [(p, i) for p in (1, 2) for i in (11, 12, 13, 14, 20, 21, *range(30, 36))]
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    got = collections.validate_edges(frame(plan, "plan_id long, proposal_id long, source_id long, target_id long, confidence double"), frame([(1, 10), (2, 10)], "plan_id long, id long"), frame(scope, "plan_id long, id long"), frame([(13, 10)], "source_id long, target_id long"), frame([(10, 14)], "a long, b long"))
    reasons = {(r.plan_id, r.proposal_id): r.reason for r in got.collect()}
    assert len(reasons) == len(plan) and reasons[1, 1] is None and reasons[2, 1] is None
    assert [reasons[1, i] for i in range(2, 9)] == ["pair", "self", "unknown", "no subject", "confidence", "connected", "suppressed"]
    assert [reasons[1, 20 + i] for i in range(6)] == [None] * 4 + ["cap"] * 2


def test_new_collections(spark):
    long = "x" * 40
    plan = [(1, "Tools", long, 0.9), (2, "word", long, 0.9), (3, "Rust async runtimes", long, 0.9), (4, "Good new name", "short", 0.9), (5, "Another new name", long, 0.6), (6, "One member only", long, 0.9), (7, "Quite fine name", long, 0.8), (8, " ", long, 0.9)]
    members = [(i, m) for i in range(1, 9) for m in ((1,) if i == 6 else (1, 2, 3))]
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    got = collections.validate_collections(frame(plan, "proposal_id long, name string, description string, confidence double"), frame(members, "proposal_id long, item_id long"), frame([(9, "Async Rust runtimes")], "collection_id long, name string"), frame([(1, False), (2, False), (3, True)], "id long, deleted boolean"), frame([("another new name", 1)], "name_key string, item_id long"))
    rows = {r.proposal_id: r for r in got.collect()}
    assert [rows[i].reason for i in range(1, 9)] == ["generic", "single word", "folded", "description", "confidence", "members", None, "empty"]
    assert rows[3].into == 9 and rows[7].members == 2 and rows[5].members == 1


def test_drops(spark):
    rows = [
        (1, 0, "file", "a.webloc"), (1, 1, "url", "https://a.b/c?utm_source=x"), (1, 2, "url", "https://www.a.b/c"),
        (2, 0, "file", "p.png"), (2, 1, "url", "https://a.b/p.png"),
        (3, 0, "text", " https://a.b/x "), (4, 0, "text", "see https://a.b/x"), (5, 0, "text", "a note"), (5, 1, "url", "https://a.b/y"), (6, 0, "url", "mailto:x"),
    ]
    got = records.resolve_drops(spark.createDataFrame(rows, "batch_id long, pos int, kind string, value string"), preparation.canonical_url).collect()
    assert sorted((r.batch_id, r.kind, r.value, r.source_url or "") for r in got) == [
        (1, "url", "https://a.b/c?utm_source=x", ""), (2, "file", "p.png", "https://a.b/p.png"), (3, "url", "https://a.b/x", ""), (4, "text", "see https://a.b/x", ""), (5, "url", "https://a.b/y", ""),
    ]


def test_stems_equal_sqlite():
    words = "relational conditional rational valency hesitancy digitizer conformably radically differently vilely analogously vietnamization predication operator feudalism decisiveness hopefulness callousness formality sensitivity sensibility triplicate formative formalize electricity electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologous communism activate angularity effective bowdlerize probate rate cease control roll running hoping hopped agreed feed sized skies ties dying news".split()
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(w, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    db.executemany("INSERT INTO t(rowid, w) VALUES (?, ?)", list(enumerate(words, 1)))
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    want = {doc: term for term, doc in db.execute("SELECT term, doc FROM v")}
    assert [lexical.porter(w) for w in words] == [want[i] for i in range(1, len(words) + 1)]


@pytest.mark.parametrize("block", [2000, 5])
def test_knn_equals_brute_force(spark, monkeypatch, block):
    """Few queries and many, chunks of an item in several batches, a floor, ties, vectors without length."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 40)
    rng = np.random.default_rng(4)
    rows = [(i % 60, i // 60, "summary" if i < 60 else "body", [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(240)] + [(99, 0, "summary", [0.0] * 6), (98, 0, "summary", None)]
    v = spark.createDataFrame(rows, "item_id long, chunk int, role string, vector array<float>").repartition(5)
    q = v.filter("role = 'summary' AND item_id < 12").select(F.col("item_id").alias("query_id"), "vector")
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    for floor in (None, 0.5):
        got = {(r.query_id, r.pos): (r.item_id, round(r.score, 6)) for r in vectors.knn(v, q, 7, floor=floor, exclude_self=True).collect()}
        want = {}
        for i, _, _, x in rows[:12]:
            if not np.any(x):
                continue
            best = {}
            for j, _, role, y in rows[:240]:
                if j != i and np.any(y):
                    c = round(float(unit(x) @ unit(y)), 9)
                    best[j] = max(best.get(j, (-9.0, 0.0)), (c * (1.0 if role == "summary" else 0.8), c))
            ranked = sorted((-s, j) for j, (s, c) in best.items() if floor is None or c >= floor)[:7]
            want |= {(i, p): (j, round(-s, 6)) for p, (s, j) in enumerate(ranked, 1)}
        assert got == want


def test_page_facts(spark):
    html = """<html lang="en"><head><title>Plain</title><meta property="og:title" content="The &amp; title"><meta content='Words' name='Description'>
<link rel="canonical" href="/a/b"><link rel="icon" sizes="64x64" href="i.png"><link rel="apple-touch-icon" href="https://x.y/t.png"><meta name="author" content="@someone">
<!-- <meta name="date" content="1999"> --><meta name="date" content="2024-02-03"><script type="application/ld+json">{"@type": "NewsArticle"}</script></head>
<body><nav><p>Home and other things that are long enough to pass as text here</p></nav><p>A first sentence.</p><p>menu</p><p><a href="/x">all of this is a link, forty characters at least</a></p></body></html>"""
    p = spark.createDataFrame([(1, "https://e.org/d/page", html), (2, None, None)], "page_id long, url string, html string")
    m = {r.page_id: r for r in pages.page_metadata(p).collect()}
    assert (m[1].title, m[1].description, m[1].canonical, m[1].favicon) == ("The & title", "Words", "https://e.org/a/b", "https://x.y/t.png")
    assert (m[1].published, m[1].byline, m[1].ld_types, m[1].lang) == ("2024-02-03", "someone", ["NewsArticle"], "en") and m[2].title is None
    t = {r.page_id: r for r in pages.page_text(p).collect()}
    assert t[1].text == "A first sentence." and t[1].partial and t[2].text == ""


def test_broken_json_and_shared_folder(spark):
    rows = spark.createDataFrame([('["a", 1, null, "b"]',), ("[",), (None,), ('{"x": 1}',)], "topics string")
    assert [r.topics for r in tables.read_rows(rows, ["topics"]).collect()] == [["a", "b"], [], [], []]


def test_batches_are_let_go(spark, tmp_path):
    """Complete, single, late, and past the gate, over several micro-batches."""
    minute = lambda n: f"2024-01-01 10:{n:02d}:00"
    steps = [[(1, 1, 2, minute(0)), (2, 5, 1, minute(0)), (3, 7, 3, minute(1))], [(1, 2, 2, minute(1)), (1, 2, 2, minute(1))], [(1, 3, 2, minute(3)), (9, 9, 9, minute(40))], [(9, 8, 9, minute(41))]]
    out = []
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, "batch_id long, item_id long, size int, ts string").selectExpr("batch_id", "item_id", "size", "cast(ts AS timestamp) AS ts").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        stream = spark.readStream.schema("batch_id long, item_id long, size int, ts timestamp").parquet(str(tmp_path / "in" / "*"))
        query = streams.group_complete(stream, 90).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda b, _: out.extend((r.batch_id, r["items"], r.reason) for r in b.collect())).start()
        query.awaitTermination(60)
    assert sorted(out) == [(1, 1, "late"), (1, 2, "complete"), (2, 1, "single"), (3, 1, "gate")]

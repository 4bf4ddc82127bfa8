"""Hand-made rows for rules that the tables don't reach."""

from __future__ import annotations

import re
import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import curation, fusion, index, lexical, lifecycle, linking, preparation, vectors
from corpuskit.plans import registry


def one(spark, column, value="x", kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://WWW.Example.com/a/index.html?b=2&a=1&utm_source=x#top", "https://example.com/a?a=1&b=2"),
        ("https://m.youtube.com/watch?v=1&list=2&t=3", "https://youtube.com/watch?v=1"),
        ("https://x.com/u/status/1?s=20", "https://twitter.com/u/status/1"),
        ("https://app.example.com/#/route", "https://app.example.com#/route"),
        ("https://example.com/", "https://example.com"),
        ("ftp://example.com", None),
        ("", None),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, preparation.canonical_url(F.col("s")), url) == want


@pytest.mark.parametrize(("raw", "want"), [("85%", 0.85), ("85", 0.5), ("0.85", 0.85), ("1", 1.0), ("x", 0.5), (None, 0.5), ("-1%", 0.5), (" 7 % ", 0.07)])
def test_clean_confidence(spark, raw, want):
    assert one(spark, preparation.clean_confidence(F.col("s")), raw) == pytest.approx(want)


def test_text_scalars(spark):
    assert one(spark, T.truncate(F.col("s"), 5), "abcd efg") == "abcd…"
    assert one(spark, T.truncate(F.col("s"), 6), "abcd  efg") == "abcd…"
    assert one(spark, T.normalize_name(F.col("s")), " A--b,  C! ") == "a b c"
    assert one(spark, T.tokenize(F.col("s")), "Ünï-Code 42!") == ["ünï", "code", "42"]
    assert [one(spark, T.is_natural_language(F.col("s")), q) for q in ("pdf", "where pdf", "a b c d", "x?", "", None)] == [False, True, True, True, False, False]
    assert one(spark, T.fnv1a32(F.col("s")), "hello") == 0x4F9F2CAB
    ages = [(10, "just now"), (60, "1 minute ago"), (150, "3 minutes ago"), (3600, "1 hour ago"), (86400, "yesterday"), (86400 * 3, "3 days ago"), (86400 * 400, "1 year ago"), (-5, "just now")]
    for age, want in ages:
        assert one(spark, T.relative_time(F.lit(0) - F.col("s"), F.lit(0)), age, "long") == want


def chunks(text, size, most):
    """The packing rules, plainly."""
    flat = re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", text)).strip(" ")
    units = [u for u in re.split(r'\n{2,}|(?<=[.!?])\s+(?=[A-Z0-9"“(])', flat) if u.strip(" ")]
    out, current = [], ""
    for u in units:
        if len(u) > size:
            out += [current.strip(" ")] * bool(current.strip(" ")) + [u[i : i + size].strip(" ") for i in range(0, len(u), size)]
            current = ""
            continue
        if len(current) + len(u) + 1 > size:
            out += [current.strip(" ")] * bool(current.strip(" "))
            current = ""
        current = f"{current}\n{u}" if current else u
    out += [current.strip(" ")] * bool(current.strip(" "))
    return out[:most]


@pytest.mark.parametrize(("size", "most"), [(1800, 24), (120, 5)])
def test_chunk_bodies(spark, sf_dir, size, most):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    got = {}
    for r in preparation.chunk_bodies(texts, size, most).orderBy("id", "chunk").collect():
        got.setdefault(r.id, []).append(r.text)
    for r in texts.collect():
        assert got.get(r.id, []) == chunks(r.text or "", size, most)


def test_bm25_equals_sqlite(spark):
    """The ranking function against SQLite's own full-text index."""
    rows = [(0, "red fox fox", "the red fox jumps over a red fence"), (1, "blue", "a fox is not a blue whale"), (2, "whale song", "whales sing red songs"), (3, "other", "nothing to see"), (4, "more", "even less to see here")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(title, extracted_text)")
    con.executemany("INSERT INTO f(rowid, title, extracted_text) VALUES (?, ?, ?)", rows)
    want = dict(con.execute("SELECT rowid, bm25(f, 8.0, 1.0) FROM f WHERE f MATCH 'red OR fox'").fetchall())
    items = spark.createDataFrame([(*r, False) for r in rows], "id long, title string, extracted_text string, deleted boolean")
    idx = index.build_index(index.index_docs(items))
    q = spark.createDataFrame([(1, ["red", "fox"])], "query_id long, tokens array<string>")
    got = {r.id: r["rank"] for r in lexical.bm25(idx, lexical.term_groups(q, synonyms=False)).collect()}
    assert got == pytest.approx(want)


def test_synonyms_and_snippets(spark):
    q = spark.createDataFrame([(1, ["repo", "pic"])], "query_id long, tokens array<string>")
    assert {(r.group_no, r.term) for r in lexical.term_groups(q).collect()} == {(0, "repo"), (0, "repository"), (1, "pic"), (1, "image"), (1, "photo")}
    text = "a" * 100 + " needle " + "b" * 200
    got = one(spark, lexical.fallback_snippet(F.col("s"), F.array(F.lit("zzz"), F.lit("needle"))), text)
    assert "needle" in got and got.startswith("…") and got.endswith("…")
    assert one(spark, lexical.fallback_snippet(F.col("s"), F.array(F.lit("zzz"))), "short") == "short"


def test_status_transitions(spark):
    rows = [(1, 1, "extract", "failed"), (1, 2, "understand", "ok"), (1, 3, "relate", "ok"), (2, 1, "extract", "ok"), (2, 2, "embed", "ok"), (2, 3, "understand", "ok"), (2, 4, "relate", "ok"), (3, 5, "understand", "failed"), (4, 1, "extract", "ok"), (4, 2, "relate", "partial")]
    events = spark.createDataFrame([(i, seq * 10, seq, s, o) for i, seq, s, o in rows], "item_id long, at_us long, seq long, stage string, outcome string")
    assert {r.item_id: r.status for r in lifecycle.status_fold(events).collect()} == {1: "PARTIAL", 2: "READY", 3: "AI_FAILED", 4: "PARTIAL"}


def test_time_boost(spark):
    day = 86400
    boost = lambda t, since, until: one(spark, fusion.time_boost(F.col("s"), F.lit(since), F.lit(until), F.lit(100 * day)), t, "long")
    assert boost(95 * day, 90 * day, None) == 1.5
    assert boost(85 * day, 90 * day, None) == pytest.approx(1.25)
    assert boost(10 * day, 90 * day, None) == 1.0
    assert boost(57 * day, None, 50 * day) == pytest.approx(1.25)


def test_blocked_knn_equals_broadcast(spark, monkeypatch):
    rows = [(i, 0, "summary", [float((i * 7) % 5), float((i * 3) % 4), 1.0]) for i in range(30)]
    v = spark.createDataFrame(rows, "item_id long, chunk int, role string, vector array<double>")
    q = v.select(F.col("item_id").alias("query_id"), "vector")
    want = sorted(map(tuple, vectors.knn(v, q, 4).collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, vectors.knn(v, q, 4).collect())) == want


def test_near_duplicates_grow_with_their_groups(spark):
    rows = [(i, "Same Title!", "d", "url", False) for i in range(50)] + [(90, "other", "d", "url", False)]
    items = spark.createDataFrame(rows, "id long, title string, domain string, type string, deleted boolean")
    got = vectors.near_duplicates(items, T.normalize_name(F.col("title"))).collect()
    assert len(got) == 49 and {r.a for r in got} == {0}


def test_undo_of_all_is_the_start(spark):
    rows = [(i, i % 3, "f", float(i), i * 10, False) for i in range(12)]
    audit = spark.createDataFrame(rows, "seq long, entity_id long, field string, value double, at_us long, undone boolean")
    got = curation.undo(audit, audit).collect()
    assert len(got) == 12 and all(r.value is None and not r.conflict for r in got)
    last = curation.undo(audit, audit.filter("seq >= 9")).collect()
    assert {(r.entity_id, r.value) for r in last} == {(0, 6.0), (1, 7.0), (2, 8.0)}


def test_plans(spark):
    """The plans that scale: top-k before the shuffle, no pairs of everything with everything."""
    items = spark.range(1000).selectExpr("id", "'d' AS domain", "id AS captured_s", "CAST(NULL AS BIGINT) AS parent_id", "false AS deleted")
    plan = linking.same_group(items, items, "domain")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    plan = linking.within_window(items, items)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_similar_names_of_copies(spark):
    """Copies hang on the least id of their class, and classes are compared once: no pair of all copies."""
    rows = [(i, ("Red Bolt small", "small, bolt RED", "the red bolt, small")[i % 3]) for i in range(3000)] + [(5000, "red bolt large small"), (5001, "Large small red bolt"), (5002, "other"), (5003, "the of"), (5004, None)]
    got = sorted(map(tuple, linking.similar_names(spark.createDataFrame(rows, "id long, name string")).collect()))
    assert got == [(0, i, 1.0) for i in range(1, 3000)] + [(0, 5000, 0.75), (5000, 5001, 1.0)]


def test_similar_names_of_all_pairs(spark):
    """Every pair of alike names is given, those of copies and of equal ids too, as brute force finds them."""
    names = ["red bolt small", "small, bolt RED", "the red bolt", "red bolt large small", "blue nut", "nut blue big", "the of", None, "red nut"]
    rows = [(i, names[i % len(names)]) for i in range(120)] + [(5, "red bolt"), (None, "red bolt"), (700, "zinc")] + [(i, "zinc") for i in range(1000, 1700)]
    sets = [(i, frozenset(re.findall(r"\w+", (n or "").lower())) - set(linking.NAME_STOPWORDS)) for i, n in rows if i is not None]
    want = Counter((a, b, round(len(x & y) / len(x | y), 9)) for a, x in sets for b, y in sets if a < b and x and y and len(x & y) >= 0.6 * len(x | y))
    got = linking.similar_names(spark.createDataFrame(rows, "id long, name string"), every=True).collect()
    assert Counter((r.a, r.b, round(r.similarity, 9)) for r in got) == want


def test_query_of_similar_names_gives_pairs_of_copies(spark, tmp_path):
    rows = [(i, "Red Bolt", "SMALL TIN", "Brand 7") for i in range(4)] + [(9, "Red Bolt", "LARGE TIN", "Brand 7")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((r.a, r.b) for r in registry.queries()["similar_names"](spark, str(tmp_path)).collect())
    assert got == [(a, b) for a in (0, 1, 2, 3) for b in (1, 2, 3, 9) if a < b]


def test_best_of_a_block_in_bounded_memory():
    """What one block of vectors holds for its queries besides themselves: a few copies of the cosines of ``AT_ONCE``."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    draw, n, dims = np.random.default_rng(1), vectors.VECTOR_BLOCK, 8
    rows = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(draw.normal(size=m * dims)), dims).cast(pa.list_(pa.float64()))
    asked = pa.table({"query_id": pa.array(range(300)), "q": rows(300)})
    given = pa.table({"item_id": pa.array(range(n)), "weight": pa.array(np.ones(n)), "v": rows(n)})
    tracemalloc.start()
    found = vectors._best(asked, given, 10, 0.3, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 3000 and peak < 100e6, peak

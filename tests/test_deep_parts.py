"""Parts with an algorithm of their own: hashed buckets, order-dependent folds, records over lines, folder trees, names."""

from __future__ import annotations

import csv
import io
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.operators import analytics, collections, fusion, vectors
from corpuskit.sources import files


@pytest.fixture(scope="module")
def clustered(spark):
    """Clusters of near vectors with string ids, a third of all rows in one of them, and zeros."""
    rng = np.random.default_rng(11)
    centre = rng.normal(size=(40, 32))
    which = np.where(rng.random(900) < 0.33, 0, rng.integers(0, 40, 900))
    v = centre[which] + rng.normal(size=(900, 32)) * 0.25
    v[890:] = 0
    return v, spark.createDataFrame([(f"i{n:03d}", 0, "summary", x.tolist()) for n, x in enumerate(v)], "item_id string, chunk int, role string, vector array<double>")


def test_hashed_knn(spark, clustered, monkeypatch):
    """Nine of ten neighbours or more; the same rows whatever the blocks; every cosine is exact."""
    v, frame = clustered
    q = frame.filter("substring(item_id, 4, 1) = '0'").select(F.col("item_id").alias("query_id"), "vector")
    exact = vectors.knn(frame, q, 10, exclude_self=True)
    got = vectors.knn(frame, q, 10, exclude_self=True, mode="lsh")
    rows = sorted(map(tuple, got.collect()))
    assert fusion.recall(got, exact).first().recall >= 0.9
    known = {(r.query_id, r.item_id): r.cosine for r in vectors.knn(frame, q, 900).collect()}
    assert all(known[r[0], r[1]] == r[4] for r in rows) and not any(r[0] == r[1] for r in rows)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 20)
    assert sorted(map(tuple, vectors.knn(frame, q, 10, exclude_self=True, mode="lsh").collect())) == rows
    assert vectors.knn(frame.limit(0), q, 10, mode="lsh").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_hashed_near_pairs(spark, clustered, monkeypatch):
    v, frame = clustered
    rows = frame.select(F.col("item_id").alias("id"), F.lit("k").alias("kind"), F.col("vector").alias("v"))
    exact = {tuple(r) for r in vectors.near_pairs(rows, 0.95).collect()}
    unit = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    x, y = np.nonzero(np.triu(np.round(unit @ unit.T, 9) >= 0.95, 1))
    assert exact == {(f"i{a:03d}", f"i{b:03d}") for a, b in zip(x, y, strict=True)} and len(exact) > 300
    hashed = {tuple(r) for r in vectors.near_pairs(rows, 0.95, "lsh").collect()}
    assert hashed <= exact and len(hashed) >= 0.9 * len(exact)
    monkeypatch.setattr(vectors, "PAIR_BLOCK", 30)
    assert {tuple(r) for r in vectors.near_pairs(rows, 0.95, "lsh").collect()} == hashed


def test_copies_are_as_many_rows_as_members(spark):
    rows = [(f"c{n:03d}", 0, "summary", [1.0, 2.0]) for n in range(60)] + [("z1", 0, "summary", [0.0, 0.0]), ("z2", 0, "summary", [0.0, 0.0]), ("near", 0, "summary", [1.01, 2.0])]
    frame = spark.createDataFrame(rows, "item_id string, chunk int, role string, vector array<double>")
    items = spark.createDataFrame([(r[0], f"t {r[0]}", "d", "url", False) for r in rows], "id string, title string, domain string, type string, deleted boolean")
    got = {tuple(r) for r in vectors.near_duplicates(items, F.lower("title"), frame).collect()}
    assert got == {("c000", f"c{n:03d}") for n in range(1, 60)} | {("c000", "near")}


def test_new_collections_fold_within_their_plan(spark):
    """Against the fold written out: each accepted proposal is known to those after it."""
    rng = np.random.default_rng(2)
    words = ["rust", "async", "garden", "plans", "music", "theory"]
    plan = [(n, n % 4, " ".join(rng.choice(words, rng.integers(1, 4))).title() + " Notes", "What belongs here and also why it does, at length", float(rng.choice([0.2, 0.9, 0.95]))) for n in range(160)]
    plan += [(900, 9, "Same Name Here", "A description of what it is for, long enough to pass", 0.9), (901, 9, "Same Name Here", "A description of what it is for, long enough to pass", 0.9), (902, 9, "Other Name There", "x", 0.9), (903, 9, "Other Name There", "A description of what it is for, long enough to pass", 0.9), (904, 9, "Known Topic Alpha", "A description of what it is for, long enough to pass", 0.9), (905, 9, "Known Topic Alpha", "A description of what it is for, long enough to pass", 0.9)]
    proposed = [(p[0], i) for p in plan for i in (1, 2, 3, 4)]
    frame = spark.createDataFrame(plan, "proposal_id long, plan_id long, name string, description string, confidence double")
    items = spark.createDataFrame([(i, False) for i in range(6)], "id long, deleted boolean")
    known = spark.createDataFrame([(5, "Known Topic Alpha")], "collection_id long, name string")
    off = spark.createDataFrame([], "name_key string, item_id long")
    got = {r.proposal_id: r for r in collections.validate_collections(frame, spark.createDataFrame(proposed, "proposal_id long, item_id long"), known, items, off).collect()}
    key = lambda n: re.sub(r"\s+", " ", n.lower()).strip()
    bag = lambda n: {w for w in key(n).split() if w not in collections.NAME_STOPWORDS}

    def alike(a, b):
        if not bag(a) or not bag(b):
            return key(a) == key(b)
        return key(a) == key(b) or len(bag(a) & bag(b)) / len(bag(a) | bag(b)) >= collections.NAME_FOLD

    taken = {}
    for pid, plan_id, name, description, confidence in plan:
        r = got[pid]
        if r.reason is not None and r.reason not in ("folded", "description", "confidence", "members"):
            continue  # a name that is no name
        if alike(name, "Known Topic Alpha"):
            assert (r.reason, r["into"]) == ("folded", 5)
            continue
        into = next((p for p, n in taken.get(plan_id, []) if alike(name, n)), None)
        if into is not None:
            assert (r.reason, r.into_proposal) == ("folded", into), (pid, name)
        elif len(description) < collections.MIN_DESCRIPTION:
            assert r.reason == "description"
        elif confidence < collections.MIN_CONFIDENCE:
            assert r.reason == "confidence"
        else:
            assert r.reason is None and r.members == 4, (pid, name, r)
            taken.setdefault(plan_id, []).append((pid, name))
    assert got[900].reason is None and got[901].into_proposal == 900
    assert got[902].reason == "description" and got[903].reason is None
    assert sum(r.into_proposal is not None for r in got.values()) > 10


def test_copies_of_a_new_collection_meet_its_first(spark):
    """Names are cut into words before they are joined, the copies of one are no pairs, and a plan is more than a batch."""
    long = "A description of what it is for, long enough to pass"
    plan = [(n, n % 2, ("Same Garden Plans", "garden, same plans!")[n // 2 % 2], long, 0.9) for n in range(300)] + [(300, 0, "Garden Plans Same Notes", long, 0.9), (301, 0, "Quite Other Theory", long, 0.9), (302, 1, "...", long, 0.9)]
    frame = spark.createDataFrame(plan, "proposal_id long, plan_id long, name string, description string, confidence double")
    members = spark.createDataFrame([(p[0], i) for p in plan for i in (1, 2)], "proposal_id long, item_id long")
    items = spark.createDataFrame([(1, False), (2, False)], "id long, deleted boolean")
    none = spark.createDataFrame([], "name_key string, item_id long"), spark.createDataFrame([(1, None), (2, "..."), (3, "the of")], "collection_id long, name string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = collections.validate_collections(frame, members, none[1], items, none[0])
        got = {r.proposal_id: (r.reason, r.into_proposal) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {**{n: ("folded", n % 2) for n in range(2, 301)}, 0: (None, None), 1: (None, None), 301: (None, None), 302: ("empty", None)}
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("regexp" in line for line in joins) and "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_records_over_lines(spark):
    text = 'name,note,n\r\na,"first\nsecond, with ""quotes""",1\n\nb,plain,2\n"c\n\nd",,3\n'
    whole = spark.createDataFrame([("p", text), ("q", "a;b\n1;2\n"), ("open", 'x,y\n1,"never closed\n2,3\n'), ("none", None), ("empty", "")], "path string, text string")
    got = {r.path: r for r in files.profile_delimited(whole).collect()}
    want = [r for r in csv.reader(io.StringIO(text.replace("\r\n", "\n"))) if r]
    assert got["p"].n_rows == len(want) - 1 == 3 and list(got["p"].columns) == want[0]
    flat = lambda c: re.sub(r"\s*\n\s*", " ", c)
    assert list(got["p"].preview) == [" · ".join(f"{h}: {flat(c)}" for h, c in zip(want[0], r, strict=True)) for r in want[1:]]
    assert got["q"].n_rows == 1 and got["q"].delimiter == ";" and got["open"].n_rows == 1


def test_folder_tree(spark):
    rows = [("r", f"d{n % 3}/e{n % 2}/f{n}.py", n) for n in range(900)] + [("r", "top.txt", 5), ("r", ".git/x", 9), ("q", "one.md", None)]
    got = {(r.root, r.dir): (r.depth, r.n_files, r.n_dirs, r.bytes) for r in files.folder_tree(spark.createDataFrame(rows, "root string, rel string, size long")).collect()}
    assert got["r", ""] == (0, 901, 9, sum(range(900)) + 5) and got["q", ""] == (0, 1, 0, 0)
    assert got["r", "d1"] == (1, 300, 2, sum(n for n in range(900) if n % 3 == 1))
    assert got["r", "d1/e0"] == (2, 150, 0, sum(n for n in range(900) if n % 3 == 1 and n % 2 == 0)) and len(got) == 11


def test_names_of_any_number_of_words(spark):
    texts = ["Abc " * 50_000, "Abc-Def Ghi_ Jkl", "x" * 100_000 + " End", "Aa_b Cc Dd9"]
    rows = analytics.entities(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 8).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.id, r.pos)):
        got.setdefault(r.id, []).append(r.name)
    pattern = re.compile(r"\b([A-Z][A-Za-z0-9]+(?:[ -][A-Z][A-Za-z0-9]+)*)\b", re.ASCII)
    for i, t in enumerate(texts):
        want = list(dict.fromkeys(m[1] for m in pattern.finditer(t) if len(m[1]) >= 3 and m[1].lower() not in analytics.KEYWORD_STOPWORDS))[:8]
        assert got.get(i, []) == want
    assert math.isclose(len(got[0][0]), 4 * 50_000 - 1)


def test_meta_text(spark):
    from corpuskit.operators.records import meta_text

    rows = [('{"description": " d ", "headings": ["h1", "h2"], "repo": {"owner": "o", "stars": 3, "topics": ["t"]}, "folder": {"extensions": {"py": 2, "md": 1}}, "og": {"siteName": "s"}}',), ("{broken",), (None,), ('{"headings": "no list", "description": ""}',)]
    assert [r.t for r in spark.createDataFrame(rows, "m string").select(meta_text(F.col("m")).alias("t")).collect()] == ["d h1 h2 s o t md py", "", "", ""]


def test_items_of_many_collections(spark):
    """An item in twelve collections is asked for deeper than the others, and gets as many others."""
    rng = np.random.default_rng(8)
    v = {i: rng.normal(size=6).tolist() for i in range(40)}
    frame = spark.createDataFrame([(i, 0, "summary", x) for i, x in v.items()], "item_id long, chunk int, role string, vector array<double>")
    rows = [(c, 0) for c in range(12)] + [(c, 1 + (c * 3 + k) % 39) for c in range(16) for k in range(3)]
    members = spark.createDataFrame(sorted(set(rows)), "collection_id long, item_id long")
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    want = {}
    for i in v:
        scored = []
        for c in range(16):
            others = [unit(v[m]) for cc, m in set(rows) if cc == c and m != i]
            if others:
                scored.append((-round(float(unit(v[i]) @ unit(sum(others))), 6), c))
        want[i] = [c for _, c in sorted(scored)[:3]]
    got = {}
    for r in sorted(vectors.collection_candidates(frame, members, frame.select("item_id"), 3).collect(), key=lambda r: r.pos):
        got.setdefault(r.item_id, []).append(r.collection_id)
    assert got == want

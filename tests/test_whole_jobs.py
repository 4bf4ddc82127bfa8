"""Queries that cover whole tables and texts, beside their smaller forms with SQL, against brute force."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.operators import vectors
from corpuskit.operators.analytics import KEYWORD_STOPWORDS
from corpuskit.operators.lifecycle import STAGE_GRAPH
from corpuskit.plans import curation_queries, model, registry


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Long texts whose last words stand far behind the title and the 24th chunk."""
    path = str(tmp_path_factory.mktemp("small"))
    rng = np.random.default_rng(3)
    filler = lambda n: ". ".join("Common " + " ".join(rng.choice([f"w{i}" for i in range(300)], 12)) for _ in range(n))
    docs = [(0, filler(1500) + ". Zebra quantum harvest lantern", "en"), (1, filler(40), "de"), (2, filler(3), None), (3, "Short", "fr"), (4, None, "en"), (6, "", "en")]
    spark.createDataFrame([(i, t, lang, "s") for i, t, lang in docs], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(7, "zebra quantum harvest lantern")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def embed(text, codes, dims=384):
    words = [w for w in re.findall("[a-z0-9]+", (text or "").lower()) if len(w) >= 2 and w not in vectors.HASH_STOPWORDS]
    counts = {}
    for term, n in [(w, 1.0) for w in words] + [(f"{a}_{b}", 0.5) for a, b in zip(words, words[1:])]:
        counts[term] = counts.get(term, 0) + n
    out = np.zeros(dims)
    for term, n in counts.items():
        bucket, sign = codes[term]
        out[bucket] += sign * (1 + math.log(n))
    return counts, out / (np.linalg.norm(out) or 1.0)


class Codes(dict):
    def __missing__(self, term):
        def fnv(start):
            h = start
            for c in term.encode():
                h = ((h ^ c) * 16777619) & 0xFFFFFFFF
            return h

        return fnv(2166136261) % 384, 1.0 if fnv(2538058380) % 2 == 1 else -1.0


def test_vectors_cover_whole_texts(spark, small):
    rows = curation_queries.embedded(model.items(spark, small)).collect()
    texts = {r.id: (r.title, r.extracted_text) for r in model.items(spark, small).collect()}
    assert len(rows) == len({(r.item_id, r.chunk) for r in rows}) and max(r.chunk for r in rows if r.item_id == 0) > 24
    assert {r.item_id for r in rows if r.role == "summary"} == set(texts)
    codes = Codes()
    for i, (title, text) in texts.items():
        body = [r for r in rows if r.item_id == i and r.chunk > 0]
        assert all(r.role == "body" for r in body)
        assert np.allclose(next(r.vector for r in rows if r.item_id == i and r.chunk == 0), embed(title, codes)[1])
        # Every word of the text has its bucket in some chunk, the last ones too.
        last = (re.findall("[a-z0-9]+", (text or "").lower()) or [None])[-1]
        assert last is None or any(r.vector[codes[last][0]] != 0 for r in body)
    assert 3 in {r.item_id for r in rows if r.role == "body"} and {4, 6}.isdisjoint({r.item_id for r in rows if r.role == "body"})


def test_hybrid_search_finds_the_end_of_a_long_text(spark, small):
    q = vectors.hash_embed(spark.createDataFrame([(7, "zebra quantum harvest lantern")], "id long, text string")).select(F.col("id").alias("query_id"), "vector")
    best = vectors.knn(curation_queries.embedded(model.items(spark, small)), q, 1).first()
    assert best.item_id == 0 and best.cosine > 0.1 and best.score == pytest.approx(0.8 * best.cosine)
    assert registry.FLAGSHIP == "hybrid_search_full"
    got = registry.queries()["hybrid_search_full"](spark, small).collect()
    assert got[0].query_id == 7 and got[0].id == 0 and got[0].pos == 1


def names(text):
    out = []
    for m in re.finditer(r"\b([A-Z][A-Za-z0-9]+(?:[ -][A-Z][A-Za-z0-9]+)*)\b", text or "", re.ASCII):
        if len(m[1]) >= 3 and m[1].lower() not in KEYWORD_STOPWORDS and m[1] not in out:
            out.append(m[1])
    return out[:8]


def test_entities_of_every_language(spark, tmp_path):
    texts = {0: "Ada Lovelace met Babbage.", 1: "Der Zug nach München, Über Bonn-Beuel und ÉCole Nord.", 2: "Paris Nord et Lyon", 3: None, 4: " ".join(f"Name{i}, x" for i in range(12))}
    langs = {0: "en", 1: "de", 2: None, 3: "fr", 4: "es"}
    spark.createDataFrame([(i, t, langs[i]) for i, t in texts.items()], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.id, r.pos, r.name) for r in registry.queries()["entities_full"](spark, str(tmp_path)).collect())
    assert got == [(i, n + 1, name) for i, t in texts.items() for n, name in enumerate(names(t))]
    assert {g[0] for g in got} == {0, 1, 2, 4}


def test_entities_of_the_tables(spark, sf_dir):
    got = sorted((r.id, r.pos, r.name) for r in registry.queries()["entities_full"](spark, sf_dir).collect())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted((d.doc_id, n + 1, name) for d in docs for n, name in enumerate(names(d.text)))


def test_pending_stages_after_any_result(spark, tmp_path):
    """Values below 20 are failures, below 60 partial results, others are ok: all of them are results."""
    kinds = {"extract": "signup", "embed": "view", "understand": "click", "relate": "purchase", "index": "other"}
    events = [(1, "extract", 90.0), (2, "extract", 5.0), (2, "embed", 90.0), (3, "extract", 40.0), (3, "embed", 10.0), (3, "understand", 90.0), (4, "index", 90.0), (4, "relate", 90.0), (5, "understand", 30.0), (5, "understand", 90.0)]
    rows = [(n, item, kinds[stage], value, f"2024-01-0{item} 00:00:00") for n, (item, stage, value) in enumerate(events)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts string")
    frame.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    want = set()
    for item in {e[0] for e in events}:
        done = {s for i, s, _ in events if i == item}
        want |= {(item, s) for s, needs in STAGE_GRAPH if needs and s not in done and done.issuperset(needs)}
    assert {tuple(r) for r in registry.queries()["pending_stages_full"](spark, str(tmp_path)).collect()} == want
    assert {(1, "embed"), (1, "understand"), (2, "understand"), (3, "index")} <= want


def test_near_duplicates_by_vector(spark, monkeypatch):
    """Blocks give what all pairs give: near vectors of one type, whatever the titles; no deleted items, no zeros."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 8))
    v = np.concatenate([base[rng.integers(0, 12, 80)] + rng.normal(size=(80, 8)) * 0.2, np.zeros((2, 8))])
    kinds = ["url", "pdf"]
    items = spark.createDataFrame([(i, f"title {i}" if i > 3 else "Same", "d", kinds[i % 2], i % 10 == 9) for i in range(82)], "id long, title string, domain string, type string, deleted boolean")
    rows = [(i, 0, "summary", x.tolist()) for i, x in enumerate(v)] + [(i, 1, "body", base[0].tolist()) for i in range(82)]
    frame = spark.createDataFrame(rows, "item_id long, chunk int, role string, vector array<double>")
    unit = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    live = [i for i in range(82) if i % 10 != 9]
    near = {(a, b) for a in live for b in live if a < b and a % 2 == b % 2 and unit[a] @ unit[b] >= 0.95}
    for block in (4096, 7):
        monkeypatch.setattr(vectors, "PAIR_BLOCK", block)
        got = [tuple(r) for r in vectors.near_duplicates(items, F.lower("title"), frame, mode="exact").collect()]
        assert len(got) == len(set(got)) and set(got) == near | {(0, 2), (1, 3)}
    assert len(near) > 20


def test_chunk_bodies_keeps_the_end_of_a_long_text(spark, small):
    rows = [r for r in registry.queries()["chunk_bodies"](spark, small).collect() if r.id == 0]
    assert sorted(r.chunk for r in rows) == list(range(len(rows))) and len(rows) > 24
    text = next(r.extracted_text for r in model.items(spark, small).filter("id = 0").collect())
    assert " ".join(r.text for r in sorted(rows, key=lambda r: r.chunk)).split() == text.split()

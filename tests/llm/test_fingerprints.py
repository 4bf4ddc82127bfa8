import hashlib
import re
import time

import pytest

from corpuskit.llm import fingerprints

PARTS = re.compile(fingerprints._PARTS)


def parts(text):
    return {m.group(0) for m in PARTS.finditer(text)}


def likeness(a, b):
    a, b = parts(a), parts(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_equals_brute_force(spark, docs, empty):
    rows = docs.select("doc_id", "text").collect()
    order = sorted({-1 if r.doc_id is None else r.doc_id for r in rows})
    text = {-1 if r.doc_id is None else r.doc_id: r.text or "" for r in rows}
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(rows)
    prints = {}
    for r in got:
        key = -1 if r.doc_id is None else r.doc_id
        own, following = text[key], text[order[(order.index(key) + 1) % len(order)]]
        m = len(own) // 4
        edited = own[: len(own) - m] + following[:m]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(likeness(own, edited)) and r.near_next == pytest.approx(likeness(own, following))
        assert prints.setdefault(own, r.fingerprint) == r.fingerprint
        assert prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
    assert fingerprints.fingerprints(empty).count() == 0


def test_large_differences_are_peeled(spark, tmp_path):
    rows = [(i, "\n".join(f"line {i * 37 + j}" for j in range(n))) for i, n in enumerate((3, 40, 400, 41, 1))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.read.parquet(str(tmp_path / "d"))).collect()}
    for i, t in rows:
        assert got[i].near_next == pytest.approx(likeness(t, rows[(i + 1) % 5][1]))


def test_long_runs_of_marks_take_linear_time(spark, tmp_path):
    rows = [(1, "a" * 200 + "." * 1_000_000 + "b"), (2, "a" * 200 + "." * 1_000_000), (3, "a" * 1_000_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    began = time.time()
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got[1].n_chars == 1_000_201 and time.time() - began < 60
    assert parts("a" * 170 + "... and so on") == {"a" * 170 + "...", " and so on"}


def test_failed_sketches_are_tried_again(spark, monkeypatch):
    """Sketches too small for their digests fail at first; larger ones under fresh hashes settle every pair."""
    monkeypatch.setattr(fingerprints, "CELLS", 0.5)
    rows = [(i, 0, list(range(n)), list(range(n // 2, n + 7))) for i, n in enumerate((0, 1, 10, 100, 1000))]
    got = {r.uid: r.likeness for r in fingerprints.likeness(spark.createDataFrame(rows, "uid long, kind int, a array<long>, b array<long>")).collect()}
    for uid, _, a, b in rows:
        assert got.get(uid, 0.0) == pytest.approx(len(set(a) & set(b)) / len(set(a) | set(b)))

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import quality
from tests.llm.conftest import ROWS, WORD


def kind(b):
    for k, some in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:!?'\"()-")):
        if chr(b) in some:
            return k
    return 7 if b > 127 else 6


def brute_shapes(text):
    """Shares of kinds and neighbours, and the shapes, text by text."""
    words, raw = [w.encode() for w in WORD.findall(text or "")], (text or "").encode()
    if not words:
        return np.zeros(8 + 64 + 10)
    n, kinds = len(words), [kind(b) for b in raw]
    share = [kinds.count(k) / len(raw) for k in range(8)]
    near = [math.sqrt(sum(p == (a, b) for p in zip(kinds, kinds[1:], strict=False)) / max(1, len(raw) - 1)) for a in range(8) for b in range(8)]
    logs = np.log1p([len(w) for w in words])
    mean = lambda f: sum(map(f, words)) / n
    shapes = [math.log1p(n), logs.mean(), logs.std(), len(set(words)) / n, mean(lambda w: len(w) <= 3), mean(lambda w: kind(w[0]) == 1), mean(lambda w: kind(w[-1]) == 5), mean(lambda w: kind(w[-1]) == 6), mean(lambda w: len(w) == 1), math.log1p(n / (1 + kinds.count(4)))]
    return np.array(share + near + shapes)


def test_vectors():
    texts = [r[1] for r in ROWS] + ["a|b | C!! 9\r\n\n x", "#" * 300, "w " * 1000]
    got = quality.vectors(pa.array(texts))
    assert got.shape == (len(texts), quality.SIZE)
    for x, t in zip(got, texts, strict=True):
        np.testing.assert_allclose(x[: 8 + 64 + 10], brute_shapes(t), atol=1e-12)
        n = len(WORD.findall(t or ""))
        assert abs((x[-quality.WORDS :] ** 2).sum() - (n > 0)) < 1e-9
    # A text's vector does not hang on its neighbours.
    np.testing.assert_allclose(got, np.concatenate([quality.vectors(pa.array([t], pa.string())) for t in texts]))


def test_preferences_have_the_least_loss():
    rng = np.random.default_rng(3)
    true = rng.normal(size=quality.SIZE) * (np.arange(quality.SIZE) < 5)
    a, b = rng.normal(size=(2, 900, quality.SIZE))
    swap = rng.random(900) > 1 / (1 + np.exp(-(a - b) @ true))
    a[swap], b[swap] = b[swap], a[swap].copy()
    model = quality.fit_preferences(a, b, ridge=0.05)
    scale = np.concatenate((a, b)).std(0)
    loss = lambda w: np.logaddexp(0, -(a - b) @ w).mean() + 0.025 * ((w * scale) ** 2).sum()
    least = loss(model.weight)
    for _ in range(50):
        assert loss(model.weight + rng.normal(size=quality.SIZE) * 10.0 ** rng.uniform(-4, -1)) > least
    assert np.corrcoef(model.weight[:5], true[:5])[0, 1] > 0.9


def test_pairings_use_every_text():
    for good, bad in ((7, 3), (3, 7), (1, 1), (5, 5)):
        one, other = quality.pairings(good, bad, 2)
        assert len(one) == 2 * max(good, bad) and set(one) == set(range(good)) and set(other) == set(range(bad))
    assert len(quality.pairings(0, 4)[0]) == 0


def test_threshold_is_the_best_quantile(spark):
    rng = np.random.default_rng(5)
    worth = np.concatenate((rng.normal(-1, 1, 80), rng.normal(1, 1, 240))).round(3)
    label = [0] * 80 + [1] * 240
    scored = spark.createDataFrame([(i, float(w)) for i, w in enumerate(worth)] + [(None, 0.5), (999, 99.0)], "doc_id long, worth double")
    labels = spark.createDataFrame([(i, k, "x") for i, k in enumerate(label)] + [(5000, 1, "y"), (1, None, "z"), (2, 7, "z")], "doc_id long, quality int, worth string")
    cut = quality.threshold(scored, labels)
    wrong = lambda c: sum((w >= c) != k for w, k in zip(worth, label, strict=True) if k == 0) / 80 + sum(w < c for w, k in zip(worth, label, strict=True) if k == 1) / 240
    edges = (np.arange(quality.BINS + 1) - quality.BINS // 2) / quality.FINE
    assert wrong(cut) <= min(wrong(c) for c in edges if -5 < c < 5) + 1e-9
    assert quality.threshold(scored, labels.filter("quality = 1")) == 0.0


def test_hard_rows(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 5), (1, 1, 5), (8, 0, 5), (10, 0, 5), (10, 1, 5), (None, 1, 5), (77, 0, 5), (7, None, 5)], "doc_id long, quality int, text int")
    out = quality.score(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    texts = {}
    for r, (_, t, *_) in zip(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(ROWS, key=lambda r: (r[0] is None, r[0])), strict=True):
        texts.setdefault(t or "", set()).add(r.score)
    assert all(len(s) == 1 for s in texts.values())
    assert quality.score(empty, labels).count() == 0
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.score(docs, labels.filter("quality = 1")).collect()} == {0.5}


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op13_quality(spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = ([r for r in rows if r.quality == k] for k in (1, 0))
    right = [sum(r.predicted == k for r in some) / len(some) for k, some in ((1, good), (0, bad))]
    assert min(right) > 0.9
    above = sum(g.score > b.score for g in good for b in bad) / (len(good) * len(bad))
    assert above > 0.97
    everyone = out.collect()
    assert len(everyone) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.predicted == (r.score >= 0.7) for r in everyone)


@pytest.mark.parametrize("rows", [2, 5])
def test_sample_is_bounded(spark, docs, rows, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit_preferences", lambda a, b: seen.append((a, b)))
    labels = spark.range(14).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    quality.fit(docs, labels, rows=rows)
    (a, b), = seen
    assert len(np.unique(a, axis=0)) <= rows and len(np.unique(b, axis=0)) <= rows

import math
from collections import Counter

import pytest

from corpuskit.llm import domain
from tests.llm.conftest import WORD


def counts(texts):
    pair, history = Counter(), Counter()
    for t in texts:
        prev = "\0"
        for w in WORD.findall(t or ""):
            pair[prev, w] += 1
            history[prev] += 1
            prev = w
    return pair, history


def brute(rows, targets, vocabulary):
    (pt, ht), (pb, hb) = counts(targets), counts([t for _, t in rows])
    v = vocabulary
    want = []
    for doc_id, text in rows:
        words, prev, loss = WORD.findall(text or ""), "\0", 0.0
        po, ho = counts([text])
        scale = sum(pt.values()) / sum(pb.values())
        for w in words:
            loss -= math.log((pt[prev, w] + 1 / v) / (ht[prev] + 1))
            loss += math.log(((pb[prev, w] - po[prev, w]) * scale + 1 / v) / ((hb[prev] - ho[prev]) * scale + 1))
            prev = w
        want.append((str(doc_id), len(words), round(loss / len(words), 6) if words else None))
    return want


@pytest.mark.parametrize("block, hot", [(1 << 20, 16), (300, 16), (1 << 20, 1), (600, 2)])
def test_equals_brute_force(spark, docs, empty, block, hot, monkeypatch):
    monkeypatch.setattr(domain, "BLOCK", block)
    monkeypatch.setattr(domain, "HOT", hot)
    monkeypatch.setattr(domain, "BUCKET", 2000)
    target = spark.createDataFrame([("The quick brown fox of the tests",), (None,), ("w1 w2 w3",)], "text string")

    rows = docs.select("doc_id", "text").collect()
    texts = docs.selectExpr("0L AS row", "false AS target", "text").union(target.selectExpr("0L", "true", "text"))
    v = domain._statistics(texts)[3]
    assert v == pytest.approx(len({w for t in texts.collect() for w in WORD.findall(t.text or "")}), rel=0.05)
    want = brute([(r.doc_id, r.text) for r in rows], [r.text for r in target.collect()], v)
    got = domain.scores(docs, target).collect()
    assert sorted(want, key=str) == sorted(((str(r.doc_id), r.n_tokens, None if r.score is None else round(r.score, 6)) for r in got), key=str)
    assert domain.scores(empty, target).count() == 0
    assert domain.scores(docs, target.limit(0)).count() == len(rows)

def test_documents_that_stand_twice_are_known_to_the_background(spark, tmp_path):
    """A text without its like has a higher background loss than one that stands twice."""
    rows = [(i, " ".join(f"w{(i * 7919 + j * j * 31 + j) % 997}" for j in range(80))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    target = spark.createDataFrame([("w1 w2 w3",)], "text string")
    got = {r.doc_id: r.loss_background for r in domain.scores(spark.read.parquet(str(tmp_path / "d")), target).collect()}
    twice = [v for k, v in got.items() if k >= 100 or k < 10]
    assert max(twice) < min(v for k, v in got.items() if 10 <= k < 100)

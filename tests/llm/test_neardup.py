import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpuskit.llm import neardup
from corpuskit.llm.common import Words
from tests.llm.conftest import WORD


def weights(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    union = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in union) for d in set(a) & set(b))


def brute(rows):
    """Class of each row by comparing all pairs."""
    sets = [weights(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def check(out, rows):
    group = brute(rows)
    ids = {}
    for (doc_id, _), g in zip(rows, group):
        ids.setdefault(g, []).append(doc_id)
    want = sorted(str((d, min((x for x in ids[g] if x is not None), default=None))) for (d, _), g in zip(rows, group))
    got = out.collect()
    assert sorted(str((r.doc_id, r.class_id)) for r in got) == want
    assert sum(r.keep for r in got) == len(set(group))


def test_hard_cases(spark, docs, empty):
    check(neardup.classes(docs), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id IN (0, 1)").count() == 1 and kept.filter("doc_id = 10").count() == 1
    assert kept.filter("doc_id IN (2, 3, 4)").count() == 3
    assert neardup.classes(empty).count() == 0


@pytest.mark.parametrize("block", [8, 1024])
def test_chains_and_near_copies(spark, tmp_path, monkeypatch, block):
    """Copies of one text with edits: some reach it only over others, some not at all."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(5)
    rows, base = [], [f"t{rng.randrange(10**6)}" for _ in range(150)]
    for i in range(60):
        words = list(base) if i % 3 or not rows else rows[-1][1].split()
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((100 - i, " ".join(words)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    check(neardup.classes(spark.read.parquet(str(tmp_path / "d"))), rows)


def test_registers_estimate_similarity():
    a = " ".join(f"w{i}" for i in range(400))
    b = " ".join(f"w{i}" for i in range(40, 440)) + " w1 w2 w3 w4 w5 w6" * 5
    row, value, weight = neardup.shingles(Words(pa.array([a, b])))
    sketch = neardup.sketches(row, value, weight, 2, 4096)
    assert abs((sketch[0] == sketch[1]).mean() - similarity(weights(a), weights(b))) < 0.03
    exact = neardup.similarity((value[row == 0], weight[row == 0]), (value[row == 1], weight[row == 1]))
    assert exact == pytest.approx(similarity(weights(a), weights(b)))
    assert np.array_equal(sketch, neardup.sketches(row, value, weight, 2, 4096))


def test_words_that_polynomial_hashes_confuse(spark, tmp_path):
    one, other = "a", "b"
    while len(one) < 1024:
        one, other = one + other, other + one
    rows = [(1, one), (2, other), (3, one)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    check(neardup.classes(spark.read.parquet(str(tmp_path / "d"))), rows)


def test_recall_on_the_table(spark, sf_dir):
    """Classes of the table against all pairs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    check(neardup.classes(docs), [(r.doc_id, r.text) for r in docs.collect()])

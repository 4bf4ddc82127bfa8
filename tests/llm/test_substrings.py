import hashlib
from collections import Counter

import pytest

from corpuskit.llm import substrings
from tests.llm.conftest import WORD


def brute(texts, k):
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("k", [5, 35])
def test_hard_cases(spark, docs, k):
    rows = docs.select("doc_id", "text").collect()
    want = sorted(str((r.doc_id, *b)) for r, b in zip(rows, brute([r.text for r in rows], k)))
    assert sorted(str(tuple(r)) for r in substrings.removals(docs, k).collect()) == want


def test_split_buckets_give_the_same(spark, docs):
    numbered = substrings._numbered(docs.select("doc_id", "text"))
    as_set = lambda df: {(r.row, x.start, tuple(sorted(x.hits)) if x.hits is not None else tuple(range(x.n))) for r in df.collect() for x in r.runs}
    assert as_set(substrings.repeated_windows(numbered, 5, hot=1)) == as_set(substrings.repeated_windows(numbered, 5))


def test_texts_keep_their_white_space(spark, docs, empty):
    out = substrings.deduplicated(docs, 35)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text == docs.filter("doc_id = 0").first().text
    assert got[13].text == "one more" and got[13].n_chars == 8
    assert got[9].text == "tail" and 8 not in got and 10 not in got
    assert substrings.removals(empty).count() == 0 and substrings.deduplicated(empty).count() == 0


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomial_hashes_confuse(spark, tmp_path):
    one, other = thue_morse(1024)
    rows = [(1, " ".join(["w"] * 34 + [one])), (2, " ".join(["w"] * 34 + [other])), (3, one), (4, other), (5, one)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert {(r.doc_id, r.n_removed) for r in substrings.removals(docs).collect()} == {(1, 0), (2, 0), (3, 0), (4, 0), (5, 0)}
    for k in (1, 2):
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removals(docs, k).collect()]
        assert sorted(got) == sorted((i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], k)))


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows], 35)))
    assert sorted(tuple(r) for r in substrings.op4_substrings(spark, sf_dir).collect()) == want

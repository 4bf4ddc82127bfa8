import math
import random
import re

from corpuskit.llm import licenses

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORDS.findall((text or "").encode().lower())
    places, labels = [], set()
    for label, phrase in licenses.PHRASES.items():
        p = phrase.encode().split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def same(rows, docs):
    want = sorted(str((d.doc_id, *brute(d.text))) for d in docs.select("doc_id", "text").collect())
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in rows) == want


def test_hard_cases(spark, docs, empty):
    rows = licenses.scan(docs).collect()
    same(rows, docs)
    six = next(r for r in rows if r.doc_id == 6)
    assert (six.base_labels, six.labels, six.score) == ("apache,gpl,mit", "apache,gpl,mit", 1.0)
    assert licenses.scan(empty).count() == 0


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    same(licenses.op3_licenses(spark, sf_dir).collect(), docs)


def test_notices_by_position_and_key_phrase():
    index = licenses.Index()
    text, _ = licenses.NOTICES["mit-text"]
    assert index.scan(f"Copyright 2020.\n{text.upper()}".encode())[5] == "mit-text"
    edited = text.replace("obtaining a copy", "who is now obtaining one copy")
    assert index.scan(edited.encode())[5] == "mit-text"
    assert index.scan(text.replace("free of charge", "for a fee").encode())[5] == ""
    shuffled = " ".join(reversed(text.split()))
    assert index.scan(shuffled.encode())[5] == ""
    score = index.scan(edited.encode())[6]
    assert 0.6 <= score <= 1.0


def brute_labels(text, index):
    """Labels and score by trying every start of every template."""
    words = WORDS.findall((text or "").encode().lower())
    found = {}
    for t in index.templates:
        for start in range(-len(t.words), len(words) + 1):
            if t.base:
                if start >= 0 and tuple(words[start : start + len(t.words)]) == t.words:
                    found[t.label] = 1.0
                continue
            near = lambda i: any(0 <= start + i + d < len(words) and words[start + i + d] == t.words[i] for d in range(-licenses.DRIFT, licenses.DRIFT + 1))
            exact = any(0 <= start + i < len(words) and words[start + i] == t.words[i] for i in t.chosen)
            share = sum(map(near, t.chosen)) / len(t.chosen)
            part = words[max(0, start - licenses.DRIFT) : start + len(t.words) + 2 * licenses.DRIFT]
            keyed = all(any(tuple(part[i : i + len(k)]) == k for i in range(len(part))) for k in t.keys)
            if exact and share >= licenses.AGREE and keyed:
                found[t.label] = max(share, found.get(t.label, 0.0))
    return ",".join(sorted(found)), max(found.values(), default=0.0)


def test_labels_and_score_by_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", "the mit license and software", *(t for t, _ in licenses.NOTICES.values())]
    for t, _ in licenses.NOTICES.values():
        for _ in range(6):
            words = t.split()
            for _ in range(rng.randrange(7)):
                i = rng.randrange(len(words))
                words[i : i + rng.randrange(2)] = rng.choice([["the"], ["software", "license"], [], ["other"]])
            texts.append("before it " * rng.randrange(4) + " ".join(words) + " after it" * rng.randrange(3))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    n, counts = licenses.document_frequencies(docs, licenses.vocabulary())
    every = [set(WORDS.findall((t or "").encode().lower())) for t in texts]
    assert n == len(texts) and counts == {w: c for w in licenses.vocabulary() if (c := sum(w in e for e in every))}
    index = licenses.Index({w: math.log((n + 1) / c) for w, c in counts.items()})
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert got == {i: brute_labels(t, index) for i, t in enumerate(texts)}
    assert len({g[0] for g in got.values()}) > 7

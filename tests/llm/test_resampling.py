import hashlib
import math
import re
import zlib

import duckdb
import pyarrow as pa
import pytest

from corpuskit.llm import resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n_max):
    w = WORDS.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i : i + o]).encode() for o in range(1, n_max + 1) for i in range(len(w) - o + 1)]


def brute(docs, target, n_max, buckets, percent, min_words, seed):
    counts = [[0] * buckets, [0] * buckets]
    for side, texts in enumerate(([t for _, t in docs], target)):
        for t in texts:
            for f in features(t, n_max)[1]:
                counts[side][zlib.crc32(f) % buckets] += 1
    s, t = sum(counts[0]), sum(counts[1])
    gain = [math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in zip(*counts, strict=True)]
    rows = []
    for doc_id, text in docs:
        words, grams = features(text, n_max)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(words), len(grams), weight, score])
    fit = sorted((-r[4], r[0] is None, r[0] or 0) for r in rows if r[1] >= min_words)
    return rows, [f[0] for f in fit[: percent * len(fit) // 100]]


def test_prefixes_give_every_crc():
    texts = ["The quick  Brown-fox", None, "", "é ü x", "a" * 1000 + " b " + "c" * 70 + " d", "x " * 500, "-- --", "Straße 日本 9"] * 3
    prefixes = resampling.Prefixes(pa.array(texts))
    for order in (1, 2, 3, 5):
        want = []
        for i, t in enumerate(texts):
            w = features(t, 1)[0]
            want += [(i, zlib.crc32(" ".join(w[k : k + order]).encode())) for k in range(len(w) - order + 1)]
        row, crc = prefixes.ngrams(order)
        assert list(zip(row.tolist(), crc.tolist(), strict=True)) == want
    assert len(resampling.Prefixes(pa.array([], pa.string())).ngrams(1)[0]) == 0


@pytest.mark.parametrize("n_max, buckets, percent, min_words", [(2, 10_000, 25, 20), (3, 17, 50, 1), (1, 5, 100, 0), (2, 64, 0, 1)])
def test_brute_force(spark, docs, n_max, buckets, percent, min_words):
    target = ["the quick brown fox", None, "w30 w31 w32 la la", ""]
    rows, order = brute([(r.doc_id, r.text) for r in docs.collect()], target, n_max, buckets, percent, min_words, 7)
    out = resampling.resample(docs, spark.createDataFrame([(t, 0) for t in target], "text string, n long"), n_max, buckets, percent, min_words)
    got = out.collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:5])
    assert sorted(([*r[:5]] for r in got), key=key) == sorted(rows, key=key)
    chosen = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in chosen] == list(range(1, len(order) + 1))
    assert [-r.score for r in chosen] == order
    ids = [(-r.score, r.doc_id is None, r.doc_id or 0) for r in chosen]
    assert ids == sorted(ids)


def test_empty(spark, docs, empty):
    target = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(empty, target).count() == 0
    alone = resampling.resample(docs, target.limit(0)).collect()
    assert len(alone) == docs.count() and any(r.weight != 0 for r in alone)


def test_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = sorted(con.execute(resampling.ORACLE).fetchall())
    assert sorted(tuple(r) for r in resampling.op11_resampling(spark, sf_dir).collect()) == want

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import topk


def brute(rows, queries, k):
    out = {}
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def vectors(spark, seed, n, dims=9, low=-3, high=4):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) if rng.random() < 0.6 else 0.0 for x in rng.integers(low, high, dims)]) for i in range(n)]


@pytest.mark.parametrize("block", [4, 1000])
def test_equals_brute_force(spark, block):
    rows = vectors(spark, 1, 60)
    frame = spark.createDataFrame(rows, "id long, weights array<double>")
    got = {}
    for r in topk.top_k(frame.filter("id % 7 = 0"), frame, 5, block, block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(rows, {i: v for i, v in rows if i % 7 == 0}, 5)


def test_ties_repeats_and_large_weights(spark):
    big = 2.0**40
    rows = [(0, [big, 1.0]), (1, [big, big]), (2, [big, big]), (2, [0.0, 1.0]), (3, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "id long, weights array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(frame.filter("id = 0"), frame, 10).orderBy("rank").collect()]
    assert got == [(1, (1 << 63) - 1), (2, (1 << 63) - 1), (3, 1 << 40), (2, 1)]


def test_only_sound_vectors_take_part(spark):
    rows = [(0, [0.5, -0.01]), (20, None), (40, [1.0, None]), (60, [math.nan, 1.0]), (80, [math.inf, 0.0]), (100, []), (1, [1.0, 1.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    q = topk.quantized(frame)
    assert {r.id: r.weights for r in q.collect()} == {0: [32.0, -1.0], 1: [64.0, 64.0]}
    got = topk.top_k(q.filter("id % 20 = 0"), q).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 31 * 64)]
    assert topk.top_k(q.limit(0), q).count() == 0

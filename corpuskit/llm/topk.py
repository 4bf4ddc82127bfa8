"""Exact top-k search by inner product: term at a time into dense score arrays, block by block.

Vectors are sparse rows of integer weights. Queries and candidates are dealt into blocks of a fixed expected size by
a hash of their id, and every query block meets every candidate block in one task. There the candidates lie as
postings by component; each query row walks its own non-zero components and scatters ``weight * posting`` into one
score array over the block, from which the best k are picked by partition selection. The block winners, k a query
and block, meet in a ranking by query.

Defined results: a vector that is null, empty or holds a null or non-finite component takes no part, neither as
query nor as candidate; a query's own id is no candidate of it, whichever row carries it; rows that repeat an id
stay separate candidates and count as one query (the least vector); ties go to the smaller id; a shorter vector
counts as padded by zeros; rows without id take no part. Scores beyond 64 bits stop at the largest or smallest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Expected rows of a block. A task holds one block of each kind.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
_LONG = (1 << 63) - 1


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """``id, weights``: the vectors that take part, each component x as floor(scale * x) in double."""
    x = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    # floor() of a double gives a long in Spark, so it needs a double that a long can hold.
    whole = lambda v: F.when(F.abs(v) < 2.0**53, F.floor(F.when(F.abs(v) < 2.0**53, v).otherwise(0.0)).cast("double")).otherwise(v)
    return vectors.filter(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: whole(v.cast("double") * scale)).alias("weights"))


def _blocks(df: DataFrame, rows: int) -> int:
    return max(1, -(-df.count() // rows))


def _block(n: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` from two tables of ``id, weights``."""
    spark = queries.sparkSession
    queries = queries.groupBy("id").agg(F.min("weights").alias("weights"))
    n_query, n_candidate = _blocks(queries, query_block), _blocks(candidates, candidate_block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.lit(0).alias("kind"), "id", "weights", _block(n_query).alias("q"), every(n_candidate).alias("c"))
    given = candidates.select(F.lit(1).alias("kind"), "id", "weights", every(n_query).alias("q"), _block(n_candidate).alias("c"))

    def meet(table: pa.Table) -> pa.Table:
        return _meet(table, k)

    found = asked.unionByName(given.select(*asked.columns)).groupBy("q", "c").applyInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _dense(column: pa.ChunkedArray) -> np.ndarray:
    """Rows as a matrix, shorter ones padded by zeros."""
    lists = column.combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _meet(table: pa.Table, k: int) -> pa.Table:
    kind = table.column("kind").to_numpy()
    ids = table.column("id").to_numpy()
    weights = _dense(table.column("weights"))
    asked, given = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    given = given[np.argsort(ids[given], kind="stable")]  # ties go to the smaller id: to the smaller place
    q_out, v_out, s_out = [], [], []
    if len(asked) and len(given):
        given_ids = ids[given]
        bound = float(np.abs(weights[asked]).max(initial=0)) * float(np.abs(weights[given]).max(initial=0)) * weights.shape[1]
        kind_of = np.int32 if bound < 2**31 else np.int64 if bound < 2**62 else object
        whole = (lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)) if kind_of is object else (lambda m: m.astype(kind_of))
        postings = list(_postings(whole(weights[given])))
        asked_weights = whole(weights[asked])
        scores = np.zeros(len(given), dtype=kind_of)
        part = np.zeros(len(given), dtype=kind_of)
        for row, query in enumerate(asked):
            scores[:] = 0
            for term in np.flatnonzero(asked_weights[row]):
                at, held = postings[term]
                if at is None:
                    np.multiply(held, asked_weights[row, term], out=part)
                    np.add(scores, part, out=scores)
                elif len(at):
                    scores[at] += held * asked_weights[row, term]
            for place in _select(scores, given_ids, ids[query], k):
                q_out.append(int(ids[query]))
                v_out.append(int(given_ids[place]))
                s_out.append(max(-_LONG - 1, min(_LONG, int(scores[place]))))
    return pa.table({"query_id": pa.array(q_out, pa.int64()), "vec_id": pa.array(v_out, pa.int64()), "score": pa.array(s_out, pa.int64())})


def _postings(matrix: np.ndarray) -> Iterator[tuple[np.ndarray | None, np.ndarray]]:
    """By component: the places with a weight and the weights; no places where most have one."""
    for term in range(matrix.shape[1]):
        column = np.ascontiguousarray(matrix[:, term])
        at = np.flatnonzero(column)
        yield (None, column) if 2 * len(at) > len(column) else (at, column[at])


def _select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best that are not the query's own, by score and then place."""
    lo, hi = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
    others = len(scores) - (hi - lo)
    want = min(k, others)
    if not want:
        return np.zeros(0, np.int64)
    if scores.dtype == object:
        order = sorted((i for i in range(len(scores)) if not lo <= i < hi), key=lambda i: (-scores[i], i))
        return np.array(order[:want])
    reach = min(len(scores), want + (hi - lo))
    least = np.partition(scores, len(scores) - reach)[len(scores) - reach]
    places = np.flatnonzero(scores >= least)  # all ties at the edge
    places = places[(places < lo) | (places >= hi)]
    return places[np.argsort(-scores[places].astype(np.int64), kind="stable")][:want]


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors.filter(F.col("id") % 20 == 0), vectors)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

"""Importance resampling towards a target distribution, over hashed word n-grams.

A document's features are its runs of 1 to ``n_max`` words, each hashed to the CRC-32 of its bytes modulo ``buckets``.
Counts of the buckets over all documents and over the target give each bucket a gain (the log of how much more often
the target has it, smoothed by one), a document's weight is the mean gain of its features, and Gumbel noise from a hash
of its id turns the highest scores into a draw without replacement, in proportion to the weights.

CRCs come from prefixes. The texts of a slice are written end to end as lower-case words with one blank after each, and
one scan leaves the running CRC after every byte: lanes of ``LANE`` bytes step together, and the states in which lanes
begin follow by a doubling scan. The CRC of any run of words is then the prefix that ends it, less the prefix that
begins it moved on by the run's length: appending zero bytes is linear over GF(2), so the shift is four table look-ups
a factor of the length. Words of any order cost no second scan.

Two passes read the texts: one adds up the buckets, a vector of fixed length a task; the other, which gets the gains
(``buckets`` numbers), scores. The slim scores are written and drawn from: a histogram of the whole scores (their
range is bounded, as logs of counts are) finds the score where the draw ends, rows from there on are dealt out by
range, and a row's rank is its place in its range after the rows of the ranges before it.

Defined results: a null or empty text has no features and weight 0; repeated rows are documents of their own (equal
ids get equal noise; ties of score go to the smaller id, null ids last, and then to either row); a null id is hashed as
an empty one; an empty target leaves the smoothing alone; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import lean, materialize, text_bytes, text_slices

#: Text bytes that are scanned at once, and bytes of a lane.
SLICE, LANE = 2 << 20, 256
#: Reversed polynomial of CRC-32 and its first and last mask: fixed values.
POLYNOMIAL, ONES = 0xEDB88320, 0xFFFFFFFF
_NEAR = 64
_ROUNDS = 40


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The step of one byte; shifts by 0 to 63 bytes; shifts by 64, 128, ... bytes: four look-ups of 256 each."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1).astype(np.uint32)
    near = np.empty((_NEAR + 1, 4, 256), dtype=np.uint32)
    near[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(_NEAR):
        near[k + 1] = step[near[k] & 255] ^ (near[k] >> 8)
    far = np.empty((_ROUNDS, 4, 256), dtype=np.uint32)
    far[0] = near[_NEAR]
    for k in range(1, _ROUNDS):
        far[k] = _moved(far[k - 1], far[k - 1])
    return step, near[:_NEAR].reshape(-1), far


def _moved(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


_STEP, _SHORT, _FAR = _tables()


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC registers after ``size`` zero bytes each."""
    at = (size & (_NEAR - 1)).astype(np.int64) << 10
    out = _SHORT[at + (crc & 255)] ^ _SHORT[at + 256 + (crc >> 8 & 255)] ^ _SHORT[at + 512 + (crc >> 16 & 255)] ^ _SHORT[at + 768 + (crc >> 24)]
    high, k = size >> 6, 0
    while len(high) and high.any():
        odd = np.flatnonzero(high & 1)
        if len(odd):
            out[odd] = _moved(_FAR[k], out[odd])
        high, k = high >> 1, k + 1
    return out


class Prefixes:
    """Words of a run of texts, and the running CRC of their normalised text."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        n = len(data)
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        solid = (data >= 128) | ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122))
        first = solid.copy()
        if n:
            begins = np.zeros(n + 1, dtype=bool)
            begins[offsets] = True
            first[1:] &= ~solid[:-1] | begins[1:n]
        starts = np.flatnonzero(first)
        word = np.cumsum(first)[solid] - 1
        self.size = np.bincount(word, minlength=len(starts)).astype(np.int64)
        #: Row r has the words rows[r] .. rows[r + 1] - 1.
        self.rows = np.searchsorted(starts, offsets)
        self.ends = np.cumsum(self.size) + np.arange(len(starts))
        self.starts = self.ends - self.size
        text = np.full(int(self.size.sum()) + len(starts), 32, dtype=np.uint8)
        text[np.arange(len(word)) + word] = data[solid]
        self._scan(text)

    def _scan(self, text: np.ndarray) -> None:
        lanes = len(text) // LANE + 1
        steps = np.zeros(lanes * LANE, dtype=np.uint8)
        steps[: len(text)] = text
        steps = np.ascontiguousarray(steps.reshape(lanes, LANE).T)
        self.running = np.empty((LANE, lanes), dtype=np.uint32)
        crc = np.zeros(lanes, dtype=np.uint32)
        for k in range(LANE):
            crc = _STEP[(crc ^ steps[k]) & 255] ^ (crc >> 8)
            self.running[k] = crc
        state, span, k = crc.copy(), 1, int(math.log2(LANE // _NEAR))
        while span < lanes:
            state[span:] ^= _moved(_FAR[k], state[:-span])
            span, k = span * 2, k + 1
        self.begin = np.concatenate((np.zeros(1, np.uint32), state[:-1]))

    def upto(self, place: np.ndarray) -> np.ndarray:
        """The register after the first ``place`` bytes, from zero."""
        lane, within = place // LANE, place % LANE
        local = self.running[within - 1, lane]
        local[within == 0] = 0
        return local ^ shifted(self.begin[lane], within)

    def ngrams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and CRC-32 of each run of ``order`` words."""
        row = np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))
        firsts = np.flatnonzero(row[order - 1 :] == row[: len(row) - order + 1]) if len(row) >= order else np.zeros(0, np.int64)
        a, b = self.starts[firsts], self.ends[firsts + order - 1]
        return row[firsts], self.upto(b) ^ shifted(self.upto(a) ^ np.uint32(ONES), b - a) ^ np.uint32(ONES)


def bucket_counts(texts: DataFrame, n_max: int, buckets: int) -> DataFrame:
    """``bucket, n``: how often the features of column ``text`` fall into each bucket; a task sends one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, part in text_slices(batch.column(0), SLICE):
                prefixes = Prefixes(part)
                for order in range(1, n_max + 1):
                    total += np.bincount(prefixes.ngrams(order)[1] % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return texts.select("text").mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n_max: int, buckets: int) -> np.ndarray:
    """The gain of each bucket in thousandths: ``buckets`` numbers, whatever the size of the input."""
    counts = np.zeros((2, buckets), dtype=np.int64)
    both = bucket_counts(docs, n_max, buckets).select(F.lit(0).alias("side"), "bucket", "n").unionByName(bucket_counts(target, n_max, buckets).select(F.lit(1).alias("side"), "bucket", "n"))
    for side, bucket, n in both.toLocalIterator():
        counts[side, bucket] = n
    (all_s, all_t), smooth = counts.sum(1).tolist(), buckets
    of = lambda s, t: math.floor(1000 * math.log(float(t + 1) * float(all_s + smooth) / (float(s + 1) * float(all_t + smooth))))
    return np.array([of(s, t) for s, t in zip(*counts.tolist(), strict=True)], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, n_max: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for at, part in text_slices(batch.column(1), SLICE):
                prefixes = Prefixes(part)
                n, total = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)
                for order in range(1, n_max + 1):
                    row, crc = prefixes.ngrams(order)
                    n += np.bincount(row, minlength=len(part))
                    sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(gain[crc % np.uint32(len(gain))])))
                    edges = np.searchsorted(row, np.arange(len(part) + 1))
                    total += sums[edges[1:]] - sums[edges[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(np.diff(prefixes.rows).astype(np.int64)), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: F.Column, seed: int) -> F.Column:
    """Gumbel noise in thousandths from the hash of ``seed:doc_id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """``scored`` (doc_id, n_words, score and others; written, so that its rows stay) with ``rank`` of the rows drawn."""
    fit = F.coalesce(F.col("n_words") >= min_words, F.lit(False))
    histogram = scored.filter(fit).groupBy("score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    size = scored.filter(fit).count() * percent // 100
    cut = histogram.select("score", F.coalesce(above, F.lit(0)).alias("above")).filter(F.col("above") < size).agg(F.min("score")).first()[0]
    none = F.lit(None).cast("long")
    if cut is None:
        return scored.withColumn("rank", none)
    chosen = fit & (F.col("score") >= cut)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = materialize(scored.filter(chosen).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    before = ranges.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranked = ranges.join(F.broadcast(before), "part").withColumn("rank", rank)
    return scored.filter(~chosen).withColumn("rank", none).unionByName(ranked.withColumn("rank", F.when(F.col("rank") <= size, F.col("rank"))).drop("part", "before"))


def resample(docs: DataFrame, target: DataFrame, n_max: int = 2, buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of each row of ``docs`` (doc_id, text) for ``target`` (text).

    ``rank`` counts the rows drawn, ``percent`` of those with ``min_words`` words, from 1; the others have none."""
    scored = weights(docs, gains(docs, target, n_max, buckets), n_max).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    kept = materialize(scored.withColumn("place", F.monotonically_increasing_id()), "weights")
    return drawn(kept, percent, min_words).drop("place")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the benchmark's texts."""
    out = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(F.col("doc_id").cast("long"), "n_features", "weight", "score", F.col("rank").cast("long"))


#: The CRC goes bit by bit: a byte is an exclusive or, then come eight steps (marked -1).
ORACLE = r"""
WITH texts AS (
    SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL
    SELECT 1, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
features AS (
    SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM texts),
per_doc AS (SELECT side, doc_id, f, count(*) AS n FROM features GROUP BY ALL),
coded AS (
    SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM per_doc)),
hashed AS (
    SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, len(x) // 2), lambda i: [('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 10000 AS bucket FROM coded),
counts AS (
    SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM per_doc JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts),
gain AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS g FROM counts, totals),
weighed AS (
    SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
    FROM per_doc JOIN hashed USING (f) JOIN gain USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
    SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n_words,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || d.doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM texts d LEFT JOIN weighed USING (doc_id) WHERE side = 0),
placed AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT 25 * count(*) // 100 FROM placed) THEN r END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""

"""Quality scores by Bradley-Terry ranking: a text's worth is learnt from which of two texts is preferred.

A text is a vector of fixed length: shares of classes of bytes and of their neighbours, a few shapes of its words and
lines, and hashed words. With worth w.x the model says P(x preferred to y) = 1 / (1 + exp(-w.(x - y))), so the logistic
loss of a preference is that of the difference of features; Newton steps find the w of least loss (plus a ridge).

Preferences come from labels: every text of label 1 is preferred to every text of label 0. ``ROUNDS`` pairings join
each text of the larger class with one of the smaller, cyclically, each round moved on. The driver fits on a bounded
sample: the texts of ``rows`` labelled rows a class at most (those of least hash), each as a vector of ``SIZE`` numbers,
not as text. Everything else covers all rows: all texts are scored, and the threshold is a quantile of the worths of
all labelled rows, read off a histogram of them by label: the quantile where least of both classes (each counted as
one) fall on the wrong side, in the middle of the best ones. A worth becomes a score by a logistic curve that is 0.7
at the threshold.

Defined results: null, empty and wordless texts have the vector of zeros and are scored like any; labels other than 0
and 1, or of documents that are not there, count for nothing; a document that has several labels counts with each;
without labels of both classes all worths are 0, and all scores 0.5; repeated rows get equal scores; null ids pass
through, unlabelled; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm.common import Words, lean, materialize, text_slices
from corpuskit.llm.language import held_out

#: Labelled rows of a class that the model is fitted to, at most, and pairings of each.
ROWS, ROUNDS = 4096, 6
#: Text bytes that are looked at once; kinds of bytes; shapes; buckets of words.
SLICE, KINDS, SHAPES, WORDS = 1 << 20, 8, 10, 192
SIZE = KINDS + KINDS * KINDS + SHAPES + WORDS
#: Ridge, and where a score calls a text good.
RIDGE, GOOD = 1e-3, 0.7
#: Bins of the histogram of worths, and how many of them a unit of worth has around 0.
BINS, FINE = 1 << 14, 256


def _kinds() -> np.ndarray:
    """Kind of each byte: 0 small letter, 1 capital, 2 digit, 3 blank, 4 line break, 5 mark of a sentence, 6 other ASCII, 7 beyond ASCII."""
    kind = np.full(256, 6, dtype=np.uint8)
    for k, some in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9), (10, 13), b".,;:!?'\"()-", (), range(128, 256))):
        kind[list(some)] = k
    return kind


_KIND = _kinds()


def vectors(column: pa.Array) -> np.ndarray:
    """A row of ``SIZE`` numbers for each text."""
    words = Words(column)
    n = len(column)
    out = np.zeros((n, SIZE))
    size = np.diff(words.offsets)
    kind = _KIND[words.data].astype(np.int64)
    row = np.repeat(np.arange(n), size)
    out[:, :KINDS] = np.bincount(row * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS) / np.maximum(size, 1)[:, None]
    inner = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    pairs = np.bincount((row[inner] * KINDS + kind[inner]) * KINDS + kind[inner + 1], minlength=n * KINDS * KINDS)
    out[:, KINDS : KINDS + KINDS**2] = np.sqrt(pairs.reshape(n, KINDS**2) / np.maximum(size - 1, 1)[:, None])
    shapes = out[:, KINDS + KINDS**2 : KINDS + KINDS**2 + SHAPES]
    count = np.diff(words.rows)
    of = np.repeat(np.arange(n), count)
    some = np.maximum(count, 1)
    long = words.ends - words.starts
    mean = lambda x: np.bincount(of, x, minlength=n) / some
    key = words.hashes()[0]
    order = np.lexsort((key, of))
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | (of[order][1:] != of[order][:-1])
    first, last = (kind[at] for at in (words.starts, words.ends - 1))
    breaks = np.bincount(row, kind == 4, minlength=n)
    shapes[:, 0] = np.log1p(count)
    shapes[:, 1] = mean(np.log1p(long))
    shapes[:, 2] = np.sqrt(mean((np.log1p(long) - shapes[of, 1]) ** 2))
    shapes[:, 3] = np.bincount(of[order], fresh, minlength=n) / some
    shapes[:, 4] = mean(long <= 3)
    shapes[:, 5] = mean(first == 1)
    shapes[:, 6] = mean(last == 5)
    shapes[:, 7] = mean(last == 6)
    shapes[:, 8] = mean(long == 1)
    shapes[:, 9] = np.log1p(count / (1 + breaks))
    bucket = (key >> np.uint64(33)).astype(np.int64) % WORDS
    out[:, -WORDS:] = np.sqrt(np.bincount(of * WORDS + bucket, minlength=n * WORDS).reshape(n, WORDS) / some[:, None])
    out[count == 0] = 0
    return out


@dataclass
class Model:
    """Worth of a vector x: ``weight . (x - centre)``."""

    weight: np.ndarray
    centre: np.ndarray

    def worth(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.weight


def fit_preferences(better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> Model:
    """The model of least logistic loss on the differences of features of the preferred and the other vectors."""
    if not len(better):
        return Model(np.zeros(SIZE), np.zeros(SIZE))
    both = np.concatenate((better, worse))
    centre, scale = both.mean(0), both.std(0)
    scale[scale < 1e-9] = np.inf
    x = (better - worse) / scale
    w = np.zeros(x.shape[1])
    loss = lambda v: np.logaddexp(0, -x @ v).mean() + ridge / 2 * v @ v
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(x @ w, -500, 500)))  # of the preference being the other way
        slope = ridge * w - x.T @ p / len(x)
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-6 and (then := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - then < 1e-10:
            break
        w, now = w - size * step, then
    return Model(w / scale, centre)


def pairings(good: int, bad: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the preferred and of the other texts: each text of the larger class meets one of the smaller a round."""
    if not good or not bad:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, m = max(good, bad), min(good, bad)
    one = np.tile(np.arange(n), rounds)
    other = (one + np.repeat(np.arange(rounds) * 7919, n)) % m
    return (one, other) if good >= bad else (other, one)


def _labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = ROWS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id and ``label_col``); the driver gets ``2 * rows`` vectors at most."""
    known = _labels(labels, "doc_id", label_col).withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    least = known.filter("label = 0").orderBy("h", "doc_id").limit(rows).unionByName(known.filter("label = 1").orderBy("h", "doc_id").limit(rows))
    # A row for each row of the sample, bounded, so that the texts stay where they are.
    texts = docs.select("doc_id", "text").join(F.broadcast(least), "doc_id").select("label", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in text_slices(batch.column(2), SLICE):
                x = vectors(part).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(part)) for c in (0, 1)), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "h", "x"])

    seen = texts.mapInArrow(lean(run), "label int, h long, x binary")
    # Rows of one id can be many: the bound holds for rows, too.
    mine = [seen.filter(F.col("label") == k).orderBy("h", "x").limit(rows).collect() for k in (1, 0)]
    good, bad = (np.stack([np.frombuffer(r.x, dtype=np.float32) for r in some]).astype(np.float64) if some else np.zeros((0, SIZE)) for some in mine)
    one, other = pairings(len(good), len(bad))
    return fit_preferences(good[one], bad[other])


def worths(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, worth`` of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in text_slices(batch.column(1), SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(shared.value.worth(vectors(part)))], ["doc_id", "worth"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, worth double")


def _bin(worth: F.Column) -> F.Column:
    return F.least(F.greatest(F.floor(worth * FINE) + BINS // 2, F.lit(0)), F.lit(BINS - 1)).cast("int")


def threshold(scored: DataFrame, labels: DataFrame, label_col: str = "quality") -> float:
    """The worth at the quantile that parts the labels best, from the worths of all labelled rows (``BINS`` counts a label)."""
    counts = np.zeros((2, BINS), dtype=np.int64)
    known = scored.join(_labels(labels, "doc_id", label_col), "doc_id")
    for label, place, n in known.groupBy("label", _bin(F.col("worth")).alias("bin")).count().toLocalIterator():
        counts[label, place] = n
    if not counts.sum(1).all():
        return 0.0
    # Cut c: the bins below c are called bad.
    below = np.concatenate((np.zeros((2, 1), np.int64), np.cumsum(counts, 1)), axis=1)
    wrong = below[1] / below[1, -1] + 1 - below[0] / below[0, -1]
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    run = best[: int(np.argmax(np.append(np.diff(best), 2) > 1)) + 1]
    return float((run[0] + run[-1]) / 2 - BINS // 2) / FINE


def score(docs: DataFrame, labels: DataFrame, learn: F.Column | None = None, label_col: str = "quality") -> DataFrame:
    """``doc_id, worth, score, predicted`` of each row of ``docs``; only rows of both tables where ``learn`` holds teach."""
    learn = F.lit(True) if learn is None else learn
    taught = labels.filter(learn)
    model = fit(docs.filter(learn), taught, label_col)
    slim = materialize(worths(docs, model), "worths")
    flat = not model.weight.any()
    cut = 0.0 if flat else threshold(slim, taught, label_col)
    high = 0.0 if flat else math.log(GOOD / (1 - GOOD))
    value = F.lit(1.0) / (1 + F.exp(-(F.col("worth") - cut) - high))
    return slim.withColumn("score", F.when(F.col("worth") >= cut, F.greatest(value, F.lit(0.5 if flat else GOOD))).otherwise(value)).withColumn("predicted", F.when(F.col("score") >= GOOD, 1).otherwise(0))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; labels of a quarter of the ids are held out."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    out = score(read("documents"), read("labels"), ~held_out())
    return out.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.round("score", 9).alias("score"), "predicted")

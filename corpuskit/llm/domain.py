"""Cross-entropy difference: how much better a target model predicts a document than a background model.

Both are bigram models over the words of target and background together, one vocabulary of V words, with Dirichlet
smoothing: p(w|h) = (c(h,w) + a/V) / (c(h) + a). The models are matched: background counts are scaled to the target's
number of tokens. What a document counted itself is taken off the background's counts, so that it is held against all
others. Its score is the mean over its tokens of target loss less background loss, in nats: the lower, the more like
the target.

As log p(w|h) is a term of (h,w) less a term of h, a document's losses are sums over its n-grams, each of which needs
its own counts only. So every n-gram travels once: a task packs the n-grams of some documents into one block for each
bucket of the n-gram's hash (sorted keys, documents, counts). A bucket adds up the counts of its n-grams over all
blocks, turns them into terms and sends each block its documents' parts of the sums, packed in one row. An n-gram that
many documents of a block have goes to its bucket as one count for the block, and its documents stay with the block,
to which the bucket sends the counts of the corpus: so no n-gram is hot, and a bucket grows with the number of blocks
and not with that of documents. Counts cover every text; the number of buckets follows the size of the input.

Defined results: a null or empty text has no tokens, losses of 0 and a null score; empty targets leave a target model of
the smoothing alone; repeated rows are separate documents, and each counts; extra columns are ignored. The table must
give its rows in the same order when it is read again, as files do. V is a HyperLogLog estimate (2^12 registers).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm.common import Words, lean, mix64, text_slices

#: Smoothing mass of a history.
MASS = 1.0
#: Text bytes that are tokenized at once, that a block covers and that a bucket gets the n-grams of, about.
SLICE, BLOCK, BUCKET = 2 << 20, 6 << 20, 16 << 20
#: Documents of a block from which on an n-gram of it travels as one count.
HOT = 16
HLL_BITS = 12
_START = np.uint64(0xA0761D6478BD642F)
_PAIR = np.uint64(0xE7037ED1A0B428DB)
_HISTORY = np.uint64(0x8EBC6AF09C88C6E3)


def tokens_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each token."""
    return np.repeat(np.arange(len(words.rows) - 1), np.diff(words.rows)), words.hashes()[0]


def ngrams(row: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pair (history, token) and of the history at each token; bit 0 tells them apart."""
    history = np.empty_like(token)
    history[1:] = token[:-1]
    first = np.ones(len(row), dtype=bool)
    first[1:] = row[1:] != row[:-1]
    history[first] = _START
    with np.errstate(over="ignore"):
        pair = mix64(mix64(history * _PAIR) + token) | np.uint64(1)
        return pair, mix64(history ^ _HISTORY) & ~np.uint64(1)


def _statistics(texts: DataFrame) -> tuple[int, int, int, float]:
    """Tokens of target and background, bytes of all, and the distinct words of both, estimated."""
    slots = 1 << HLL_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registers = np.zeros(slots, dtype=np.int64)
        totals = np.zeros(3, dtype=np.int64)
        for batch in batches:
            target = batch.column(1).to_numpy(zero_copy_only=False)
            for at, part in text_slices(batch.column(2), SLICE):
                words = Words(part)
                row, token = tokens_of(words)
                aimed = int(target[at : at + len(part)][row].sum())
                totals += (aimed, len(row) - aimed, len(words.data))
                rest = (token << np.uint64(HLL_BITS)) | np.uint64(slots >> 1)
                # The bits above the highest set one, from 1 on.
                rank = 64 - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)
                np.maximum.at(registers, (token >> np.uint64(64 - HLL_BITS)).astype(np.int64), rank)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((np.arange(slots), [-1, -2, -3]))), pa.array(np.concatenate((registers, totals)))], ["slot", "value"])

    merged = texts.mapInArrow(run, "slot long, value long").groupBy("slot").agg(F.when(F.col("slot") >= 0, F.max("value")).otherwise(F.sum("value")).alias("value"))
    of = lambda k: F.coalesce(F.max(F.when(F.col("slot") == k, F.col("value"))), F.lit(0))
    r = merged.agg(of(-1).alias("target"), of(-2).alias("background"), of(-3).alias("bytes"), F.sum(F.when(F.col("slot") >= 0, F.pow(F.lit(2.0), -F.col("value")))).alias("inverse"), F.sum(F.when((F.col("slot") >= 0) & (F.col("value") == 0), 1).otherwise(0)).alias("zeros")).first()
    if not r.inverse:
        return 0, 0, 0, 1.0
    estimate = 0.7213 / (1 + 1.079 / slots) * slots * slots / r.inverse
    if estimate <= 2.5 * slots and r.zeros:
        estimate = slots * math.log(slots / r.zeros)
    return r.target, r.background, r.bytes, max(1.0, estimate)


#: What a block sends: to each bucket (0 on) its n-grams of few documents and the counts of the others; and, as bucket -1,
#: the documents of these others, which any bucket passes on.
_POSTINGS = ("keys", "key_sizes", "docs", "times", "rows", "target")
_HOT = ("hot_keys", "hot_target", "hot_background")
_BLOCK = "bucket int, to int, block long, " + ", ".join(f"{c} binary" for c in (*_POSTINGS, *_HOT))


def _pack(x: np.ndarray) -> bytes:
    """Bytes of the same weight together, then compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if len(x) else bytes(8)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).reshape(n)


def _blocks(texts: DataFrame, buckets: int) -> DataFrame:
    """The n-grams of some documents in one row a bucket: sorted keys, how many documents each is in, which, how often."""

    def emit(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([p[0] for p in parts])
        target = np.concatenate([p[1] for p in parts])
        base = np.cumsum([0] + [len(p[0]) for p in parts])[:-1]
        row = np.concatenate([p[2] + b for p, b in zip(parts, base, strict=True)])
        pair, history = ngrams(row, np.concatenate([p[3] for p in parts]))
        key, doc = np.concatenate((pair, history)), np.concatenate((row, row))
        if not len(key):
            return
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(key))).astype(np.uint32)
        key, doc = key[first], doc[first].astype(np.uint32)
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        unique = key[starts]
        sizes = np.diff(np.append(starts, len(key))).astype(np.uint32)
        # Rows of both tables count from 0: blocks of the target, which get nothing back, go below.
        block = int(rows[0]) if (target == 0).any() else -1 - int(rows[0])
        at = ((unique >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # in the order of keys
        hot = sizes >= HOT
        entries = np.repeat(hot, sizes)
        cold = (unique[~hot], sizes[~hot], doc[~entries], times[~entries], at[~hot])
        often = (unique[hot], sizes[hot], doc[entries], times[entries], at[hot])
        edge = np.concatenate(([0], np.cumsum(cold[1], dtype=np.int64)))
        begins = np.concatenate(([0], np.cumsum(often[1], dtype=np.int64)))[:-1]
        aimed = often[3] * (target[often[2]] != 0)
        totals = [np.add.reduceat(x, begins).astype(np.uint64) if len(begins) else np.zeros(0, np.uint64) for x in (aimed, often[3] - aimed)]
        none = bytes(8)
        for b in np.unique(at):
            lo, hi = np.searchsorted(cold[4], (b, b + 1))
            h_lo, h_hi = np.searchsorted(often[4], (b, b + 1))
            seen, local = np.unique(cold[2][edge[lo] : edge[hi]], return_inverse=True)
            packed = (np.diff(cold[0][lo:hi], prepend=np.uint64(0)), cold[1][lo:hi], local.astype(np.uint32), cold[3][edge[lo] : edge[hi]], np.diff(rows[seen], prepend=0), target[seen].astype(np.uint8))
            counts = (np.diff(often[0][h_lo:h_hi], prepend=np.uint64(0)), *(x[h_lo:h_hi] for x in totals))
            yield _one(_BLOCK, b, b, block, *map(_pack, (*packed, *counts)))
        if hot.any() and block >= 0:
            seen, local = np.unique(often[2], return_inverse=True)
            packed = (np.diff(often[0], prepend=np.uint64(0)), often[1], local.astype(np.uint32), often[3], np.diff(rows[seen], prepend=0), target[seen].astype(np.uint8))
            yield _one(_BLOCK, -1, block % buckets, block, *map(_pack, packed), none, none, none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, room = [], BLOCK
        for batch in batches:
            rows, target = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for at, part in text_slices(batch.column(2), SLICE):
                words = Words(part)
                row, token = tokens_of(words)
                parts.append((rows[at : at + len(part)], target[at : at + len(part)], row, token))
                room -= len(words.data)
                if room <= 0:
                    yield from emit(parts)
                    parts, room = [], BLOCK
        if parts:
            yield from emit(parts)

    return texts.mapInArrow(lean(run), _BLOCK)


def _one(schema: str, *values) -> pa.RecordBatch:
    """A batch of one row."""
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    of = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], of[k]) for v, k in zip(values, kinds, strict=True)], names)


#: What a block gets: parts of the sums of its documents with the counts of its frequent n-grams, and these' documents.
_SUMS = "kind int, block long, " + ", ".join(f"{c} binary" for c in ("sum_rows", "tokens", "loss_target", "loss_background", *_HOT, *_POSTINGS))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def _losses(counts: np.ndarray, times: np.ndarray, own: np.ndarray, is_pair: np.ndarray, scale: float, mass: float, vocabulary: float) -> tuple[np.ndarray, np.ndarray]:
    """What an n-gram adds to the losses of documents that have it ``times``; own: it counts in the background."""
    least = np.where(is_pair, mass / vocabulary, mass)
    sign = np.where(is_pair, -times, times).astype(np.float64)
    return sign * np.log(counts[0] + least), sign * np.log((counts[1] - np.where(own, times, 0)) * scale + least)


def _is_pair(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(1)) == 1


def _terms(blocks: DataFrame, buckets: int, scale: float, mass: float, vocabulary: float) -> DataFrame:
    """What each bucket sends to each block: its documents' parts of the sums, and the counts of its frequent n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = bytes(8)
        for bucket, group in groupby(_stream(batches), key=lambda b: b["bucket"]):
            if bucket < 0:
                for b in group:
                    yield _one(_SUMS, 1, b["block"], *[none] * 7, *(b[c] for c in _POSTINGS))
                continue
            held = [(b["block"], np.cumsum(_unpack(b["keys"], np.uint64), dtype=np.uint64), *(_unpack(b[c], np.uint32) for c in ("key_sizes", "docs", "times")), np.cumsum(_unpack(b["rows"], np.int64)), _unpack(b["target"], np.uint8), np.cumsum(_unpack(b["hot_keys"], np.uint64), dtype=np.uint64), *(_unpack(b[c], np.uint64) for c in _HOT[1:])) for b in group]
            unique = np.unique(np.concatenate([k for h in held for k in (h[1], h[7])]))
            counts = np.zeros((2, len(unique)))
            for _, keys, sizes, docs, times, _, target, hot, *both in held:
                where = np.repeat(np.searchsorted(unique, keys), sizes)
                aimed = target[docs] != 0
                counts[0] += np.bincount(where[aimed], times[aimed], len(unique))
                counts[1] += np.bincount(where[~aimed], times[~aimed], len(unique))
                place = np.searchsorted(unique, hot)
                for k in (0, 1):
                    counts[k][place] += both[k]  # the keys of a block are distinct
            pair = _is_pair(unique)
            for block, keys, sizes, docs, times, rows, target, hot, *_ in held:
                if block < 0:
                    continue
                where = np.repeat(np.searchsorted(unique, keys), sizes)
                own = target == 0
                losses = _losses(counts[:, where], times.astype(np.int64), own[docs], pair[where], scale, mass, vocabulary)
                sums = [np.bincount(docs, times * pair[where], len(rows)).astype(np.int32), *(np.bincount(docs, x, len(rows)) for x in losses)]
                place = np.searchsorted(unique, hot)
                packed = [np.diff(rows[own], prepend=0), *(x[own] for x in sums), np.diff(hot, prepend=np.uint64(0)), *(counts[k][place].astype(np.uint64) for k in (0, 1))]
                yield _one(_SUMS, 0, block, *map(_pack, packed), *[none] * 6)

    return blocks.repartitionById(buckets, F.col("to")).sortWithinPartitions("bucket").mapInArrow(lean(run), _SUMS)


def _summed(parts: DataFrame, scale: float, mass: float, vocabulary: float) -> DataFrame:
    """``row, tokens, loss_target, loss_background``: the parts of each block added up, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(_stream(batches), key=lambda p: p["block"]):
            pieces, hot, postings = [], [], None
            for p in sorted(group, key=lambda p: (p["loss_target"], p["hot_keys"])):
                if p["kind"] == 1:
                    postings = p
                    continue
                pieces.append((np.cumsum(_unpack(p["sum_rows"], np.int64)), _unpack(p["tokens"], np.int32), _unpack(p["loss_target"], np.float64), _unpack(p["loss_background"], np.float64)))
                hot.append((np.cumsum(_unpack(p["hot_keys"], np.uint64), dtype=np.uint64), *(_unpack(p[c], np.uint64) for c in _HOT[1:])))
            if postings is not None:
                known = [np.concatenate(x) for x in zip(*hot, strict=True)]
                order = np.argsort(known[0])
                keys = np.cumsum(_unpack(postings["keys"], np.uint64), dtype=np.uint64)
                sizes, docs, times = (_unpack(postings[c], np.uint32) for c in ("key_sizes", "docs", "times"))
                rows, own = np.cumsum(_unpack(postings["rows"], np.int64)), _unpack(postings["target"], np.uint8) == 0
                place = np.repeat(order[np.searchsorted(known[0], keys, sorter=order)], sizes)
                counts = np.stack((known[1], known[2])).astype(np.float64)[:, place]
                pair = np.repeat(_is_pair(keys), sizes)
                losses = _losses(counts, times.astype(np.int64), own[docs], pair, scale, mass, vocabulary)
                sums = (np.bincount(docs, times * pair, len(rows)), *(np.bincount(docs, x, len(rows)) for x in losses))
                pieces.append((rows[own], *(x[own] for x in sums)))
            rows = np.unique(np.concatenate([p[0] for p in pieces]))
            sums = np.zeros((3, len(rows)))
            for got, *values in pieces:
                at = np.searchsorted(rows, got)
                for i in range(3):
                    sums[i, at] += values[i]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["row", "tokens", "loss_target", "loss_background"])

    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(lean(run), "row long, tokens long, loss_target double, loss_background double")


def scores(docs: DataFrame, target: DataFrame, mass: float = MASS) -> DataFrame:
    """``doc_id, n_tokens, loss_target, loss_background, score``: mean losses a token, and their difference.

    ``docs`` (doc_id, text) is the background; ``target`` (text) shows what is sought."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = numbered.select("row", F.lit(False).alias("target"), "text").unionByName(target.select(F.monotonically_increasing_id().alias("row"), F.lit(True).alias("target"), "text"))
    n_target, n_background, n_bytes, vocabulary = _statistics(texts)
    buckets = max(1, -(-n_bytes // BUCKET))
    scale = n_target / n_background if n_background else 0.0
    sums = _summed(_terms(_blocks(texts, buckets), buckets, scale, mass, vocabulary), scale, mass, vocabulary)
    n = F.coalesce("tokens", F.lit(0))
    mean = lambda c: F.round(F.when(n > 0, F.col(c) / n).otherwise(0.0), 9)
    return (
        numbered.select("row", "doc_id")
        .join(sums, "row", "left")
        .select("doc_id", n.alias("n_tokens"), mean("loss_target").alias("loss_target"), mean("loss_background").alias("loss_background"), F.round(F.when(n > 0, (F.col("loss_target") - F.col("loss_background")) / n), 9).alias("score"))
    )


def op10_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the benchmark's texts as the target."""
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

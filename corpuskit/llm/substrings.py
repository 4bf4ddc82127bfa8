"""Substring dedup: windows of words that start at more than one place, found by super-k-mer partitioning.

A window is ``k`` consecutive words of one document. Its minimiser is the first of its ``M`` -word grams with the
least hash. Consecutive windows whose minimiser stands at the same place form a super-k-mer, a run of words that
travels once for all its windows. Equal windows have equal minimisers, so they meet in its bucket:

1. Headers (minimiser, 128-bit identity of the run's words, count) go to the bucket of the minimiser; equal runs are
   counted within each batch first. A bucket of one run that occurs once has no repeats, and one whose runs are all
   the same has nothing but repeats; neither needs its words.
2. Of every other bucket each distinct run sends its words once, as one packed string. The bucket sorts the windows
   of its strings and counts equal ones exactly.
3. Buckets with more than ``HOT`` distinct runs (a common line in ever new contexts) are split: their windows go
   on one by one, by their own hash.
4. The repeated windows of each run go back to all places of the run and from there to their documents.

Two windows of one super-k-mer are never equal, as their minimiser stands at different offsets.

Defined results: a null or empty text has no words; a text of fewer than ``k`` words loses none; repeated rows and
rows that share an id are separate documents; extra columns are ignored or, in ``deduplicated``, pass through. The
table must give its rows in the same order when it is read again, as files do: rows are told apart by that order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import Words, lean, materialize, mix64, shielded, spans, text_slices

K, M = 35, 4
#: Distinct runs of a bucket up to which it is sorted in one piece.
HOT = 4096
SLICE = 2 << 20
#: Bits that hold the place of a word in a slice of texts.
PLACE_BITS = 28
_GRAM = np.uint64(0xD6E8FEB86659FD93)


class Runs:
    """The super-k-mers of a run of texts: row, first word, number of windows, minimiser, identity."""

    def __init__(self, words: Words, k: int = K):
        hashes = words.hashes()
        h, n = hashes[0], len(words.starts)
        if n >> PLACE_BITS:
            raise ValueError(f"a text of more than 2^{PLACE_BITS} words")
        row_of = np.repeat(np.arange(len(words.rows) - 1), np.diff(words.rows))
        left = words.rows[1:][row_of] - np.arange(n) if n else np.zeros(0, np.int64)  # words from here to the row's end
        windows = np.flatnonzero(left >= k)
        if not len(windows):
            self.row = self.start = self.n = np.zeros(0, np.int64)
            self.minimiser = self.id1 = self.id2 = np.zeros(0, np.uint64)
            return
        m = min(M, k)
        with np.errstate(over="ignore"):
            gram = np.zeros(n, dtype=np.uint64)
            for j in range(m):
                gram[: n - j] = gram[: n - j] * _GRAM + h[j:]
            gram = mix64(gram)
            # The upper bits order the grams; the place in the lower ones makes the first of equals the least.
            place_bits = np.uint64(PLACE_BITS)
            best = (gram >> place_bits << place_bits) | np.arange(n, dtype=np.uint64)
        span, need = 1, k - m + 1
        while span < need:
            step = min(span, need - span)
            nxt = best.copy()
            nxt[: n - step] = np.minimum(best[: n - step], best[step:])
            best, span = nxt, span + step
        at = (best[windows] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        new = np.ones(len(windows), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1) | (row_of[windows[1:]] != row_of[windows[:-1]])
        first = np.flatnonzero(new)
        begin = windows[first]
        self.n = np.diff(np.append(first, len(windows)))
        self.row = row_of[begin]
        self.start = begin - words.rows[self.row]
        self.minimiser = gram[at[first]]
        self.id1, self.id2 = (spans(x, begin, self.n + k - 1) for x in hashes)


class Joined:
    """The words of a run of texts, each with one blank after it, end to end; word w is ``data[at[w]:at[w + 1] - 1]``."""

    def __init__(self, words: Words, keep: np.ndarray | None = None):
        starts, ends = (words.starts, words.ends) if keep is None else (words.starts[keep], words.ends[keep])
        sizes = ends - starts + 1
        self.at = np.concatenate(([0], np.cumsum(sizes)))
        index = np.arange(int(self.at[-1])) + np.repeat(starts - self.at[:-1], sizes)
        out = words.data[np.minimum(index, max(0, len(words.data) - 1))]
        out[self.at[1:] - 1] = 32
        self.data = out.tobytes()

    def between(self, lo: int, hi: int) -> bytes:
        """The words lo .. hi - 1, joined by one blank."""
        return self.data[self.at[lo] : self.at[hi] - 1] if hi > lo else b""


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row", F.monotonically_increasing_id())


def _headers(numbered: DataFrame, k: int) -> DataFrame:
    """One row for each distinct run of a batch slice: ``minimiser, id1, id2, n, copies`` and its first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for at, texts in text_slices(batch.column(1), SLICE):
                r = Runs(Words(texts), k)
                order = np.lexsort((r.id2, r.id1))
                change = np.ones(len(order), dtype=bool)
                change[1:] = (r.id1[order[1:]] != r.id1[order[:-1]]) | (r.id2[order[1:]] != r.id2[order[:-1]])
                begin = np.flatnonzero(change)
                first, copies = order[begin], np.diff(np.append(begin, len(order)))
                yield pa.RecordBatch.from_arrays(
                    [*map(_signed, (r.minimiser[first], r.id1[first], r.id2[first])), pa.array(r.n[first], pa.int32()), pa.array(copies, pa.int64()), pa.array(rows[at + r.row[first]], pa.int64()), pa.array(r.start[first], pa.int32())],
                    ["minimiser", "id1", "id2", "n", "copies", "row", "start"],
                )

    return numbered.select("row", "text").mapInArrow(lean(run), "minimiser long, id1 long, id2 long, n int, copies long, row long, start int")


def _places(numbered: DataFrame, k: int) -> DataFrame:
    """Every place of every run: ``id1, id2, row, start``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for at, texts in text_slices(batch.column(1), SLICE):
                r = Runs(Words(texts), k)
                yield pa.RecordBatch.from_arrays([_signed(r.id1), _signed(r.id2), pa.array(rows[at + r.row], pa.int64()), pa.array(r.start, pa.int32())], ["id1", "id2", "row", "start"])

    return numbered.select("row", "text").mapInArrow(lean(run), "id1 long, id2 long, row long, start int")


_PACKED = "minimiser long, id1 long, id2 long, n int, copies long, packed string"


def _packed(numbered: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The words of the wanted runs, joined by blanks, from the first place of each.

    All columns of ``numbered`` go into the join: it is then the same exchange as that of the last join."""
    at_text = numbered.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch.column(at_text), SLICE):
                words = Words(texts)
                joined = Joined(words)
                out: list[tuple] = []
                for first, runs in zip(words.rows.tolist(), batch.column(batch.num_columns - 1).slice(at, len(texts)), strict=False):
                    for w in runs.as_py():
                        lo = first + w["start"]
                        out.append((w["minimiser"], w["id1"], w["id2"], w["n"], w["copies"], joined.between(lo, lo + w["n"] + k - 1).decode()))
                yield _rows(out, _PACKED)

    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct("start", "n", "minimiser", "id1", "id2", "copies")).alias("runs"))
    return numbered.join(by_row, "row").select(*numbered.columns, "runs").mapInArrow(lean(run), _PACKED)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, kind in zip(columns, kinds, strict=True)], names)


def windows_of(packed: str, k: int) -> list[str]:
    words = packed.split(" ")
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def _bucket_repeats(packed: DataFrame, k: int) -> DataFrame:
    """``id1, id2, hits``: the windows of each run that occur more than once in its bucket."""
    schema = "id1 long, id2 long, hits array<int>"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, group in groupby(stream(batches), key=lambda r: r["minimiser"]):
            runs = list(group)
            windows = sorted((w, r, i) for r, x in enumerate(runs) for i, w in enumerate(windows_of(x["packed"], k)))
            hits: dict[int, list[int]] = {}
            for _, same in groupby(windows, key=lambda w: w[0]):
                places = list(same)
                if len(places) > 1 or runs[places[0][1]]["copies"] > 1:
                    for _, r, i in places:
                        hits.setdefault(r, []).append(i)
            out.extend((runs[r]["id1"], runs[r]["id2"], sorted(h)) for r, h in hits.items())
            if len(out) >= 4096:
                yield _rows(out, schema)
                out = []
        if out:
            yield _rows(out, schema)

    return packed.select("minimiser", "id1", "id2", "copies", "packed").repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(lean(run), schema)


def _single_repeats(packed: DataFrame, k: int) -> DataFrame:
    """The same for hot buckets: every window travels by its own 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                digests = [hashlib.blake2b(w.encode(), digest_size=16).digest() for w in windows_of(r["packed"], k)]
                halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                n = len(halves)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([r["id1"]] * n, pa.int64()), pa.array([r["id2"]] * n, pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array([r["copies"]] * n, pa.int64())],
                    ["w1", "w2", "id1", "id2", "i", "copies"],
                )

    windows = packed.select("id1", "id2", "copies", "packed").mapInArrow(lean(run), "w1 long, w2 long, id1 long, id2 long, i int, copies long")
    times = F.sum("copies").over(Window.partitionBy("w1", "w2"))
    return windows.withColumn("times", times).filter("times > 1").groupBy("id1", "id2").agg(F.collect_list("i").alias("hits"))


def repeated_windows(numbered: DataFrame, k: int = K, hot: int = HOT) -> DataFrame:
    """``row, runs``: for each row with repeats the places of its runs and their repeated windows (null: all ``n``)."""
    bucket = Window.partitionBy("minimiser")
    runs = (
        _headers(numbered, k)
        .repartition("minimiser")
        .groupBy("minimiser", "id1", "id2")
        .agg(F.sum("copies").alias("copies"), F.min(F.struct("row", "start", "n")).alias("at"))
        .withColumn("runs", F.count("*").over(bucket))
        .withColumn("total", F.sum("copies").over(bucket))
        .filter("total > 1")
        .select("minimiser", "id1", "id2", "copies", "at.row", "at.start", "at.n", "runs")
    )
    runs = materialize(runs, "repeated-runs")
    whole = runs.filter("runs = 1").select("id1", "id2", "n", F.lit(None).cast("array<int>").alias("hits"))
    cold, split = runs.filter((F.col("runs") > 1) & (F.col("runs") <= hot)), runs.filter(F.col("runs") > hot)
    some = _bucket_repeats(_packed(numbered, cold, k), k).unionByName(_single_repeats(_packed(numbered, split, k), k)).withColumn("n", F.lit(0))
    repeats = whole.unionByName(some)
    return _places(numbered, k).join(repeats, ["id1", "id2"]).groupBy("row").agg(F.collect_list(F.struct("start", "n", "hits")).alias("runs"))


def covered(words: Words, found: list, k: int) -> np.ndarray:
    """Which words lie in a repeated window. found: for each row its runs, or None."""
    edge = np.zeros(len(words.starts) + 1, dtype=np.int64)
    for first, runs in zip(words.rows.tolist(), found, strict=False):
        for r in runs or ():
            if r["hits"] is None:
                edge[first + r["start"]] += 1
                edge[first + r["start"] + r["n"] + k - 1] -= 1
            else:
                at = first + r["start"] + np.array(r["hits"], dtype=np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + k, -1)
    return np.cumsum(edge[:-1]) > 0


def removals(docs: DataFrame, k: int = K) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each document."""
    numbered = _numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch.column(1), SLICE):
                words = Words(texts)
                gone = covered(words, batch.column(2).slice(at, len(texts)).to_pylist(), k)
                kept = Joined(words, ~gone)
                before = np.concatenate(([0], np.cumsum(~gone)))[words.rows]
                digests = [hashlib.sha256(kept.between(lo, hi)).hexdigest() for lo, hi in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
                n = np.diff(words.rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(n - np.diff(before), pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = numbered.join(repeated_windows(numbered, k), "row", "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(lean(run), schema)


def deduplicated(docs: DataFrame, k: int = K) -> DataFrame:
    """The documents without the words that repeated windows cover, white space after each kept word as it was; those
    of which nothing is left go. Columns as in ``docs``; ``n_chars`` follows the text."""
    frame, restored = shielded(docs)
    numbered, columns = _numbered(frame), frame.columns
    at_text = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, runs in zip(batch.column(at_text), batch.column(len(columns)), strict=True):
                found = runs.as_py()
                if not found:
                    texts.append(text.as_py())
                    keep.append(True)
                    continue
                words = Words(pa.array([text.as_py()], pa.large_string()))
                gone = covered(words, [found], k)
                data = words.data.tobytes()
                ends = np.append(words.starts[1:], len(data))
                rest = b"".join(data[a:b] for a, b in zip(words.starts[~gone].tolist(), ends[~gone].tolist(), strict=True))
                texts.append(rest.decode().rstrip())
                keep.append(bool((~gone).any()))
            arrays = [pa.array(texts, pa.string()) if i == at_text else c for i, c in enumerate(batch.columns[: len(columns)])]
            yield pa.RecordBatch.from_arrays(arrays, columns).filter(pa.array(keep, pa.bool_()))

    joined = numbered.join(repeated_windows(numbered, k), "row", "left").select(*columns, "runs")
    out = restored(joined.mapInArrow(lean(run), frame.schema))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))

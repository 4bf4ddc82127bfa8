"""Near-duplicate detection by ProbMinHash over weighted word shingles.

A text's shingles are its runs of five words, weighted by how often they occur; a text of fewer words is one shingle.
Similarity is the probability Jaccard index of the two weightings (the plain Jaccard index where no shingle repeats),
and texts of 0.8 or more are linked; classes are the connected components of the links.

1. Sketch: every shingle is a Poisson process whose rate is its weight. Its arrivals come in order, each falls on a
   random register, and a register keeps the shingle of its earliest arrival. A process ends when its next arrival is
   later than the latest register of its text. Registers of two texts agree with the probability of their similarity.
2. Texts with the same words are one node. Nodes that agree in a whole band of registers share a bucket.
3. Every node is compared with one node of each of its buckets, the one that meets others most often.
4. Buckets that share nodes form a pool. Where a pool holds several components, the nodes outside its largest are
   held against all of it, block against block: an inverted index of the block's shingles gives the overlaps of a node
   with all others at once, and only links come out, one for each node and component. All comparisons are exact, on
   the whole texts. Nodes of the largest component are never compared with each other again.

Defined results: texts without words are like nothing, each a class of its own; repeated rows and copies share a
class; the class id is the least doc_id of the class (null only where all are), of equal ids one row is kept; extra
columns are ignored or pass through. The table must give its rows in the same order when it is read again, as files do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm.common import Words, lean, materialize, mix64, seeded, shielded, text_slices, unit

SHINGLE, THRESHOLD = 5, 0.8
#: Registers are BANDS * ROWS; a pair at the threshold shares no band once in more than 10,000 times.
BANDS, ROWS = 24, 5
#: Nodes of a block of a pool.
BLOCK = 1024
#: Comparisons with one node that go to a task, about.
CHUNK = 128
SLICE = 2 << 20
_STEP = np.uint64(0x8CB92BA72F3D8DD7)


def shingles(words: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of the distinct shingles of each row, in this order."""
    h, _ = words.hashes()
    count = np.diff(words.rows)
    parts = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), parts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts) + np.repeat(words.rows[:-1], parts)
    size = np.minimum(count[row], width)
    value = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            here = at + j
            value = np.where(j < size, mix64(value * _STEP + h[np.minimum(here, len(h) - 1)]), value) if len(h) else value
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return row[first], value[first], np.diff(np.append(first, len(row)))


def sketches(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """ProbMinHash registers of each row (rows x registers, 32 bits of the shingle that came first)."""
    times = np.full(n_rows * registers, np.inf)
    held = np.zeros(n_rows * registers, dtype=np.uint32)
    clock = np.zeros(len(row))
    rate = weight.astype(np.float64)
    arrival = 0
    while len(row):
        clock = clock - np.log(unit(seeded(value, 2 * arrival))) / rate
        late = times.reshape(n_rows, registers).max(axis=1)
        go = clock < late[row]
        row, value, rate, clock = row[go], value[go], rate[go], clock[go]
        spot = row * registers + (seeded(value, 2 * arrival + 1) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(times, spot, clock)
        won = times[spot] == clock
        held[spot[won]] = (value[won] >> np.uint64(32)).astype(np.uint32)
        arrival += 1
    return held.reshape(n_rows, registers)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each row and band."""
    parts = registers.reshape(len(registers), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for j in range(rows):
            key = mix64(key * _STEP + parts[:, :, j])
    return key


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard index of two weightings, each distinct sorted shingles and their weights."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    common, in_a, in_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    wa, wb = a[1][in_a].astype(np.float64), b[1][in_b].astype(np.float64)
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    kinds, times = np.unique(np.stack((wa, wb)), axis=1, return_counts=True)
    if kinds.shape[1] == 1 and kinds[0, 0] == kinds[1, 0] == 1 and a[1].max() == b[1].max() == 1:
        return len(common) / (len(a[0]) + len(b[0]) - len(common))
    total = 0.0
    for (x, y), n in zip(kinds.T, times, strict=True):
        total += n / (only_a / x + only_b / y + np.maximum(wa / x, wb / y).sum())
    return float(total)


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row", F.monotonically_increasing_id())


_SIGNED = "doc_id long, row long, id1 long, id2 long, bands array<long>"


def signatures(numbered: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, row, id1, id2`` (a 128-bit identity of the words) and band keys; rows without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch.column(2), SLICE):
                words = Words(texts)
                row, value, weight = shingles(words)
                found, first = np.unique(row, return_index=True)
                if not len(found):
                    continue
                registers = sketches(row, value, weight, len(texts), bands * rows)[found]
                keys = band_keys(registers, bands, rows)
                ids = _identities(words, found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at + found)),
                        batch.column(1).take(pa.array(at + found)),
                        pa.array(ids[0].view(np.int64)),
                        pa.array(ids[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(found) * bands + 1, bands), pa.int32()), pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    ["doc_id", "row", "id1", "id2", "bands"],
                )

    return numbered.selectExpr("cast(doc_id as long) as doc_id", "row", "text").mapInArrow(lean(run), _SIGNED)


def _identities(words: Words, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the word sequence of each row found."""
    hashes = words.hashes()
    lo, hi = words.rows[found], words.rows[found + 1]
    place = np.arange(len(words.starts)) - np.repeat(words.rows[:-1], np.diff(words.rows))
    out = []
    with np.errstate(over="ignore"):
        for which, h in enumerate(hashes):
            sums = np.zeros(len(h) + 1, dtype=np.uint64)
            np.cumsum(mix64(seeded(h, which) + place.astype(np.uint64) * _STEP), out=sums[1:])
            out.append(mix64(sums[hi] - sums[lo] + (hi - lo).astype(np.uint64)))
    return out[0], out[1]


def _compared(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of ``pairs`` (node, other) those at the threshold or above. The comparisons with one ``other`` are dealt to as
    many tasks as they fill, each of which gets its text once and streams the nodes past it."""
    chunks = pairs.groupBy("other").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    wanted = pairs.join(chunks.hint("merge"), "other").select("node", "other", chunk.alias("chunk"))
    asked = wanted.select(F.col("node").alias("row"), "other", "chunk", F.lit(1).alias("kind")).unionByName(wanted.select(F.col("other").alias("row"), "other", "chunk", F.lit(0).alias("kind")).distinct())
    by_row = asked.groupBy("row").agg(F.collect_list(F.struct("other", "chunk", "kind")).alias("asked"))
    dealt = (
        texts.join(by_row.hint("merge"), "row")
        .select("row", "text", F.explode("asked").alias("a"))
        .select("a.other", "a.chunk", "a.kind", "row", "text")
        .repartition("other", "chunk")
        .sortWithinPartitions("other", "chunk", "kind")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        against, base = None, None
        for batch in batches:
            nodes, others = [], []
            heads = [c.to_pylist() for c in batch.columns[:4]]
            for at, part in text_slices(batch.column(4), SLICE):
                row, value, weight = shingles(Words(part))
                edge = np.searchsorted(row, np.arange(len(part) + 1))
                for i in range(len(part)):
                    mine = (value[edge[i] : edge[i + 1]], weight[edge[i] : edge[i + 1]])
                    other, _, kind, node = (h[at + i] for h in heads)
                    if kind == 0:
                        against, base = other, mine
                    elif against == other and similarity(mine, base) >= threshold:
                        nodes.append(node)
                        others.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(others, pa.int64())], ["node", "other"])

    return dealt.mapInArrow(lean(run), "node long, other long")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its least node) of each node in ``links`` (node, other): labels pass along links and
    along labels until none changes. Every round is written out, so no plan grows with the rounds."""
    both = materialize(links.select("node", "other").unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "other", "component": "theirs"}), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        stepped = labels.join(near, "node").select("node", F.least("component", "theirs").alias("step"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("step"), F.col("component").alias("jump"))
        moved = materialize(stepped.join(jump, "step").select("node", F.least("step", "jump").alias("component"), "old"), "labels")
        changed = moved.filter("component <> old").limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``row, doc_id, class_id, keep`` of every row of ``docs`` numbered in its order."""
    numbered = _numbered(docs.select("doc_id", "text"))
    signed = materialize(signatures(numbered, bands, rows), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    nodes = signed.groupBy("id1", "id2").agg(first.alias("rep"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.select("id1", "id2", F.col("rep.row").alias("node"), "bands"), "nodes")
    # Buckets are counted, and their hubs found, by sums that begin before the exchange; they come back to the members by
    # merge joins, in which Spark can split a large bucket. No task needs all members of one.
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialize(keyed.join(shared.hint("merge"), "key").select("key", "node", "n"), "buckets")
    met = members.groupBy("node").agg(F.sum("n").alias("met"))
    ranked = materialize(members.join(met.hint("merge"), "node").select("key", "node", "met"), "ranked")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("least"))).alias("hub"))
    tried = ranked.join(hubs.hint("merge"), "key").select("node", (-F.col("hub.least")).alias("other")).filter("node <> other").distinct()
    tried = materialize(tried, "tried")
    # The joins of texts merge at every size, so that a small table tells what a large one will move.
    texts = numbered.select("row", "text").join(members.select(F.col("node").alias("row")).distinct().hint("merge"), "row", "left_semi")
    texts = materialize(texts, "bucket-texts")
    links = materialize(_compared(tried, texts, threshold), "links")
    labels = components(links)
    more = materialize(_within_pools(components(tried), labels, texts, threshold), "links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    return _with_classes(numbered, signed, nodes, labels)


def _within_pools(pools: DataFrame, labels: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``node, other`` of links between different components of a pool (node, component: the pool's least node)."""
    named = pools.select("node", F.col("component").alias("pool")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = named.groupBy("pool", "component").agg(F.count("*").alias("size"))
    of_pool = sizes.groupBy("pool").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.max("size").alias("top"), F.sum("size").alias("all"))
    mixed = materialize(named.join(of_pool.filter("top < all"), "pool"), "mixed-pools")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    every, few = blocks(F.col("all")), blocks(F.col("all") - F.col("top"))
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = (
        mixed.select("node", "component", "pool", own(every).alias("e"), upto(few).alias("f"), F.lit(0).alias("kind"))
        .unionByName(mixed.filter("component <> largest").select("node", "component", "pool", upto(every).alias("e"), own(few).alias("f"), F.lit(1).alias("kind")))
        .groupBy("node")
        .agg(F.collect_list(F.struct("component", "pool", "e", "f", "kind")).alias("asked"))
    )
    dealt = texts.withColumnRenamed("row", "node").join(asked.hint("merge"), "node").select("node", "text", F.explode("asked").alias("a")).select("node", "text", "a.*")

    def find(table: pa.Table) -> pa.Table:
        return _links_between(table, threshold)

    return dealt.groupBy("pool", "e", "f").applyInArrow(find, "node long, other long")


def _links_between(table: pa.Table, threshold: float) -> pa.Table:
    """Links of the rows of kind 1 with those of kind 0: for each of the former one to each other component."""
    parts = [shingles(Words(piece)) for _, piece in text_slices(table.column("text").combine_chunks(), SLICE)]
    base = np.cumsum([0] + [len(piece) for _, piece in text_slices(table.column("text").combine_chunks(), SLICE)])
    row = np.concatenate([p[0] + b for p, b in zip(parts, base[:-1], strict=True)])
    value, weight = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    edge = np.searchsorted(row, np.arange(table.num_rows + 1))
    node, component, kind = (table.column(c).to_numpy() for c in ("node", "component", "kind"))
    total = np.array([weight[a:b].sum() for a, b in zip(edge[:-1], edge[1:], strict=True)], dtype=np.float64)
    held = kind[row] == 0
    order = np.argsort(value[held], kind="stable")
    key, owner, share = value[held][order], row[held][order], (weight / np.maximum(total[row], 1))[held][order]
    nodes, others = [], []
    for y in np.flatnonzero(kind == 1):
        own = slice(edge[y], edge[y + 1])
        lo, hi = np.searchsorted(key, value[own], side="left"), np.searchsorted(key, value[own], side="right")
        index = np.arange(int((hi - lo).sum())) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
        mine = np.repeat(weight[own] / total[y], hi - lo)
        # The sum of the lesser shares is never below the similarity.
        overlap = np.bincount(owner[index], np.minimum(mine, share[index]), table.num_rows)
        near = np.flatnonzero((overlap >= threshold - 1e-9) & (component != component[y]))
        linked = set()
        for x in near[np.argsort(-overlap[near], kind="stable")]:
            if component[x] not in linked and similarity((value[own], weight[own]), (value[edge[x] : edge[x + 1]], weight[edge[x] : edge[x + 1]])) >= threshold:
                linked.add(component[x])
                nodes.append(int(node[y]))
                others.append(int(node[x]))
    return pa.table({"node": pa.array(nodes, pa.int64()), "other": pa.array(others, pa.int64())})


def _with_classes(numbered: DataFrame, signed: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    named = nodes.select("id1", "id2", "node").join(labels, "node", "left").select("id1", "id2", F.coalesce("component", "node").alias("component"))
    rows = signed.select("doc_id", "row", "id1", "id2").join(named, ["id1", "id2"]).select("row", "doc_id", "component")
    best = rows.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).getField("row").alias("kept_row"))
    worded = rows.join(best, "component").select("row", "class_id", (F.col("row") == F.col("kept_row")).alias("keep"))
    slim = numbered.select("row", F.col("doc_id").cast("long").alias("doc_id"))
    return slim.join(worded, "row", "left").select("row", "doc_id", F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("keep", F.lit(True)).alias("keep"))


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, and every document without words; columns as in ``docs``."""
    gone = classes(docs, threshold).filter("NOT keep").select("row").hint("merge")
    frame, restored = shielded(docs)
    return restored(_numbered(frame).join(gone, "row", "left_anti"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "keep")

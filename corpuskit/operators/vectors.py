"""Vector search and vector tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions.vectors import dot, l2_normalize

#: Queries that are sent to every task; more meet the vectors block by block, this many vectors a block.
QUERY_BLOCK, VECTOR_BLOCK = 2000, 16384
#: Queries whose cosines with a batch are in memory at once.
AT_ONCE = 64
#: Vectors of a block that meets another in one task, about, and those of them that are multiplied at once.
PAIR_BLOCK, PAIR_ROWS = 4096, 512
#: Tables of hyperplanes, hyperplanes of a table, and buckets of a table that a query looks into, the likeliest first.
TABLES, BITS, PROBES, SEED = 12, 8, 16, 7
#: Collections that most items are members of, at most.
OWN_FEW = 8
ROLE_WEIGHT = {"summary": 1.0, "body": 0.8}
#: Texts that are hashed at once, and where the two hashes begin.
HASH_ROWS, FNV_START, FNV_SIGN = 2048, 0x811C9DC5, 0x9747B28C

# Words that hashed vectors leave out.
HASH_STOPWORDS = "a an the and or of to in on at by for with from as is are was were be it this that these those you your we our they their i my".split()


def knn(vectors: DataFrame, queries: DataFrame, k: int, summary_only: bool = False, floor: float | None = None, exclude_self: bool = False, include: DataFrame | None = None, exclude: DataFrame | None = None, mode: str = "exact", tables: int = TABLES, bits: int = BITS, probes: int = PROBES) -> DataFrame:
    """``query_id, item_id, pos, score, cosine``: per query the best ``k`` items, each by its best chunk.

    ``mode`` "exact" compares every query with every vector; "lsh" those that share a bucket of random hyperplanes, and
    scores these exactly (see ``hashed_pairs``): most of the best, at a part of the work.

    vectors: ``item_id, chunk, role, vector``; queries: ``query_id, vector``; include, exclude: ``item_id``. Vectors
    without length, and those of another size than the query, take no part. Every query meets every vector as one matrix
    product a batch; only the ``k`` best items a query and batch leave it. Few queries are sent to all tasks, more are
    dealt into blocks that each meet all blocks of vectors."""
    v = vectors.filter("role = 'summary'") if summary_only else vectors
    if include is not None:
        v = v.join(include.select("item_id").distinct(), "item_id", "left_semi")
    if exclude is not None:
        v = v.join(exclude.select("item_id").distinct(), "item_id", "left_anti")
    weight = F.when(F.col("role") == "summary", ROLE_WEIGHT["summary"]).otherwise(ROLE_WEIGHT["body"])
    v = v.select("item_id", weight.alias("weight"), F.col("vector").cast("array<double>").alias("v")).filter(F.size("v") > 0)
    q = queries.select("query_id", F.col("vector").cast("array<double>").alias("q")).filter(F.size("q") > 0)
    names = f"query_id {dict(q.dtypes)['query_id']}, item_id {dict(v.dtypes)['item_id']}, score double, cosine double"
    if mode == "lsh":
        found = hashed_pairs(q, v, k, floor, exclude_self, names, tables, bits, probes)
    elif q.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK:
        if floor is not None and not summary_only:
            v = v.repartition("item_id").sortWithinPartitions("item_id")  # the floor asks for the best chunk of all
        found = v.mapInArrow(_streamed(q.toArrow(), k, floor, exclude_self), names)
    else:
        deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q_blocks, v_blocks = (max(1, -(-df.count() // VECTOR_BLOCK)) for df in (q, v))
        asked = q.withColumns({"a": deal("query_id", q_blocks)}).withColumn("b", every(v_blocks))
        given = v.withColumns({"b": deal("item_id", v_blocks)}).withColumn("a", every(q_blocks))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_best(left, right, k, floor, exclude_self)])

        found = asked.groupBy("a", "b").cogroup(given.groupBy("a", "b")).applyInArrow(meet, names)
    best = found.groupBy("query_id", "item_id").agg(F.max(F.struct("score", "cosine")).alias("b")).select("query_id", "item_id", "b.score", "b.cosine")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return best.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k).select("query_id", "item_id", "pos", "score", "cosine")


def signed(rows: DataFrame, column: str, tables: int, bits: int, probes: int = 1, seed: int = SEED) -> DataFrame:
    """``rows`` once for each table and bucket: a bit says on which side of a random hyperplane the vector is. With more
    ``probes`` also in the next likely buckets, those across the hyperplanes that the vector is nearest to. Vectors
    without length are in none."""
    names, at = rows.columns, rows.columns.index(column)

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for dims in np.unique(np.asarray(pc.fill_null(pc.list_value_length(table.column(at).combine_chunks()), 0))):
                places, unit = _matrix(table.column(at), dims) if dims else (np.zeros(0, np.int64), None)
                if not len(places):
                    continue
                planes = np.random.default_rng([seed, int(dims)]).normal(size=(int(dims), tables * bits))
                flips = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1
                for lo in range(0, len(places), PAIR_ROWS):
                    side = (unit[lo : lo + PAIR_ROWS] @ planes).reshape(-1, tables, bits)
                    bucket = (side > 0) @ (1 << np.arange(bits))
                    near = np.zeros((*bucket.shape, 1), np.int64) if probes <= 1 else np.argsort((side**2) @ flips.T, axis=2, kind="stable")[:, :, :probes]
                    row, nth, _ = np.indices(near.shape)
                    some = table.take(pa.array(places[lo + row.ravel()]))
                    yield from some.append_column("table", pa.array(nth.ravel().astype(np.int32))).append_column("bucket", pa.array((bucket[:, :, None] ^ near).ravel().astype(np.int32))).combine_chunks().to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.select(*names).mapInArrow(run, f"{fields}, table int, bucket int")


def hashed_pairs(q: DataFrame, v: DataFrame, k: int, floor: float | None, exclude_self: bool, names: str, tables: int, bits: int, probes: int) -> DataFrame:
    """The ``k`` best items of each bucket that a query looks into. Buckets of many vectors or queries are dealt into
    blocks that meet one another; the sizes of buckets, ``tables * 2 ** bits`` rows at most, go through the driver to all tasks."""
    asked, given = signed(q, "q", tables, bits, probes), signed(v, "v", tables, bits)
    blocks = lambda df: df.groupBy("table", "bucket").agg(F.ceil(F.count("*") / VECTOR_BLOCK).alias("n"))
    sizes = blocks(given).withColumnRenamed("n", "n_b").join(blocks(asked).withColumnRenamed("n", "n_a"), ["table", "bucket"])
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    known = sizes.collect()
    size = lambda: F.broadcast(q.sparkSession.createDataFrame(known, sizes.schema))
    left = asked.join(size(), ["table", "bucket"]).withColumn("a", deal("query_id", "n_a")).withColumn("b", every("n_b"))
    right = given.join(size(), ["table", "bucket"]).withColumn("b", deal("item_id", "n_b")).withColumn("a", every("n_a"))

    def meet(some: pa.Table, others: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_best(some, others, k, floor, exclude_self)])

    key = ["table", "bucket", "a", "b"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, names)


def _streamed(asked: pa.Table, k: int, floor: float | None, exclude_self: bool):
    """The best of each batch; the rows of an item that a batch cuts wait for the next one."""

    def run(batches):
        waiting = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if waiting is None else pa.concat_tables([waiting, table])
            if not len(table):
                continue
            same = pc.fill_null(pc.equal(table.column("item_id"), table.column("item_id")[-1]), False)
            waiting = table.filter(same)
            yield _best(asked, table.filter(pc.invert(same)), k, floor, exclude_self)
        if waiting is not None:
            yield _best(asked, waiting, k, floor, exclude_self)

    return run


def _matrix(column: pa.ChunkedArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of ``dims`` components that have a length, and these rows at length one."""
    lists = column.combine_chunks()
    rows = np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(lists), -1)) == dims)
    values = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    length = np.linalg.norm(values, axis=1)
    ok = (length > 0) & np.isfinite(length)
    return rows[ok], values[ok] / length[ok, None]


def _best(asked: pa.Table, given: pa.Table, k: int, floor: float | None, exclude_self: bool) -> pa.RecordBatch:
    """The ``k`` best items of ``given`` (item_id, weight, v) for each query of ``asked`` (query_id, q), ties to the least id."""
    out_q, out_i, scores, cosines = [], [], [], []
    for dims in np.unique(np.asarray(pc.list_value_length(asked.column("q").combine_chunks()))) if len(asked) and len(given) else ():
        at_q, q = _matrix(asked.column("q"), dims)
        at_v, v = _matrix(given.column("v"), dims)
        if not len(at_q) or not len(at_v):
            continue
        ids = given.column("item_id").combine_chunks().take(pa.array(at_v)).dictionary_encode()
        rank = np.empty(len(ids.dictionary), dtype=np.int64)
        by_id = pc.sort_indices(ids.dictionary).to_numpy()
        rank[by_id] = np.arange(len(by_id))
        item = rank[ids.indices.to_numpy()]
        order = np.argsort(item, kind="stable")
        item, v, weight = item[order], v[order], given.column("weight").to_numpy()[at_v][order]
        starts = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
        items = ids.dictionary.take(pa.array(by_id))
        q_ids = asked.column("query_id").combine_chunks().take(pa.array(at_q))
        own = pc.index_in(q_ids, value_set=items).to_numpy(zero_copy_only=False) if exclude_self else None
        for lo in range(0, len(q), AT_ONCE):
            part = q[lo : lo + AT_ONCE]
            cosine = np.round(v @ part.T, 9)
            score = cosine * weight[:, None]
            top = np.maximum.reduceat(score, starts, axis=0)
            near = np.maximum.reduceat(np.where(score == top[item], cosine, -np.inf), starts, axis=0)
            if own is not None:
                mine = own[lo : lo + AT_ONCE]
                has = np.flatnonzero(~np.isnan(mine.astype(np.float64)))
                top[mine[has].astype(np.int64), has] = -np.inf
            if floor is not None:
                top[near < floor] = -np.inf
            m = min(k, len(top))
            edge = np.partition(top, len(top) - m, axis=0)[len(top) - m]
            above = top > edge
            level = (top == edge) & (top > -np.inf)
            keep = above | (level & (np.cumsum(level, axis=0) <= m - above.sum(axis=0)))
            i, j = np.nonzero(keep)
            out_q.append(q_ids.take(pa.array(lo + j)))
            out_i.append(items.take(pa.array(i)))
            scores.append(top[i, j])
            cosines.append(near[i, j])
    joined = lambda parts, like: pa.concat_arrays(parts) if parts else pa.array([], like)
    numbers = [pa.array(np.concatenate(x) if x else np.zeros(0)) for x in (scores, cosines)]
    return pa.RecordBatch.from_arrays([joined(out_q, asked.schema.field("query_id").type), joined(out_i, given.schema.field("item_id").type), *numbers], ["query_id", "item_id", "score", "cosine"])


def load_embeddings(vectors: DataFrame, items: DataFrame, model: str) -> DataFrame:
    """Vectors of one model and of live items, at length one; those without length go."""
    unit = vectors.filter(F.col("model") == model).withColumn("vector", l2_normalize(F.col("vector"))).filter("vector IS NOT NULL")
    return unit.join(items.filter("NOT deleted").select(F.col("id").alias("item_id")), "item_id", "left_semi").select(*vectors.columns)


def similar_items(vectors: DataFrame, items: DataFrame, ids: DataFrame, k: int = 10, floor: float = 0.5, fallback: DataFrame | None = None) -> DataFrame:
    """``id, other, pos, cosine``: the live items whose summaries are nearest to that of an item. Items without a vector
    take theirs from ``fallback`` (id, other, pos), such as the hits of their words; these have no cosine."""
    live = items.filter("NOT deleted").select(F.col("id").alias("item_id"))
    summaries = vectors.filter("role = 'summary'")
    asked = ids.select(F.col("id").alias("item_id")).distinct().join(summaries, "item_id")
    near = knn(summaries, asked.select(F.col("item_id").alias("query_id"), "vector"), k, True, floor, True, include=live)
    found = near.select(F.col("query_id").alias("id"), F.col("item_id").alias("other"), "pos", "cosine")
    if fallback is None:
        return found
    bare = ids.select("id").distinct().join(summaries.select(F.col("item_id").alias("id")).distinct(), "id", "left_anti")
    words = fallback.join(bare, "id", "left_semi").join(live.withColumnRenamed("item_id", "other"), "other", "left_semi")
    place = F.row_number().over(Window.partitionBy("id").orderBy("pos", "other"))
    return found.unionByName(words.withColumn("pos", place).filter(F.col("pos") <= k).select("id", "other", "pos", F.lit(None).cast("double").alias("cosine")))


def hash_embed(texts: DataFrame, dims: int = 384) -> DataFrame:
    """``id, vector`` from ``id, text``: words of two letters or more and, at half weight, pairs of neighbours, hashed
    into ``dims`` signed buckets with 1 + ln(count), then normalised. A text without words gives zeros.

    Texts are reduced to ASCII letters and digits; other characters part words. A vector is made where its text is read:
    nothing is shuffled."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: (F.length(t) >= 2) & ~t.isin(HASH_STOPWORDS))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, HASH_ROWS):
                part = batch.slice(lo, HASH_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(_hashed(part.column(1), dims).reshape(-1)), dims).cast(pa.list_(pa.float64()))], ["id", "vector"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", words.alias("w")).mapInArrow(run, f"id {kind}, vector array<double>")


def _hashed(lists: pa.Array, dims: int) -> np.ndarray:
    """A vector for each list of words."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    coded = lists.flatten().dictionary_encode()
    code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    first = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    pairs, pair_code = np.unique(code[first] * len(names) + code[first + 1], return_inverse=True)
    left, right = pairs // max(1, len(names)), pairs % max(1, len(names))
    out = np.zeros((len(sizes), dims))
    cells = []
    for start in (FNV_START, FNV_SIGN):
        single = _fnv(np.full(len(names), start, np.uint64), names, np.arange(len(names)))
        cells.append(np.concatenate((single, _fnv(_fnv_step(single[left], 95), names, right))))  # 95: the underscore
    term = np.concatenate((code, len(names) + pair_code))
    of = np.concatenate((row, row[first]))
    key, n = np.unique(of * (len(names) + len(pairs) + 1) + term, return_counts=True)
    of, term = key // (len(names) + len(pairs) + 1), key % (len(names) + len(pairs) + 1)
    weight = 1 + np.log(np.where(term < len(names), n, 0.5 * n))
    sign = np.where(cells[1][term] % 2 == 1, 1.0, -1.0)
    np.add.at(out, (of, (cells[0][term] % dims).astype(np.int64)), sign * weight)
    length = np.sqrt((out * out).sum(1))
    return out / np.where(length > 0, length, 1.0)[:, None]


def _fnv_step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return ((state ^ np.uint64(byte) if np.isscalar(byte) else state ^ byte.astype(np.uint64)) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)


def _fnv(state: np.ndarray, names: pa.Array, which: np.ndarray) -> np.ndarray:
    """FNV-1a of ASCII strings ``names[which]``, going on from ``state``; all strings step together."""
    names = names.cast(pa.large_string())
    offsets = np.frombuffer(names.buffers()[1], dtype=np.int64)[names.offset : names.offset + len(names) + 1]
    data = np.frombuffer(names.buffers()[2], dtype=np.uint8) if len(names) and names.buffers()[2] is not None else np.zeros(0, np.uint8)
    at, end = offsets[which], offsets[which + 1]
    state = state.copy()
    live = np.flatnonzero(at < end)
    while len(live):
        state[live] = _fnv_step(state[live], data[at[live]])
        at[live] += 1
        live = live[at[live] < end[live]]
    return state


def centroids(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """``collection_id, n, centroid`` of the members' summary vectors, normalised; none where they cancel out.

    members: ``collection_id, item_id``. Components are summed by (collection, place), so a large collection is many rows."""
    unit = l2_normalize(F.col("vector"))
    of = members.join(vectors.filter("role = 'summary'").select("item_id", unit.alias("v")), "item_id").filter("v IS NOT NULL")
    parts = of.select("collection_id", F.posexplode("v").alias("i", "x")).groupBy("collection_id", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    whole = parts.groupBy("collection_id").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("sum"))
    return whole.select("collection_id", "n", "sum", l2_normalize(F.col("sum")).alias("centroid")).filter("centroid IS NOT NULL")


def collection_candidates(vectors: DataFrame, members: DataFrame, ids: DataFrame, k: int = 3) -> DataFrame:
    """``item_id, collection_id, cosine, pos``: the collections whose other members' centroid is nearest to an item.

    An item's own share is taken out of the sum of its collection; nothing is summed again. Items that are members of
    a collection meet its sum by key; all others meet all centroids as in ``knn``, which keeps ``k`` an item."""
    unit = l2_normalize(F.col("vector"))
    own = vectors.filter("role = 'summary'").select("item_id", unit.alias("v")).filter("v IS NOT NULL").join(ids.select("item_id"), "item_id", "left_semi")
    whole = centroids(members, vectors)
    mine = members.select("collection_id", "item_id").distinct()
    asked = own.select(F.col("item_id").alias("query_id"), F.col("v").alias("vector"))
    targets = whole.select(F.col("collection_id").alias("item_id"), F.lit(0).alias("chunk"), F.lit("summary").alias("role"), F.col("centroid").alias("vector"))
    # An item's own collections may stand among the first k + (their number), and are scored apart. Most items are in a
    # few: only those in more are asked for more, so that one popular item makes no rows for all others.
    held = mine.groupBy("item_id").agg(F.count("*").alias("n"))
    popular = held.filter(F.col("n") > OWN_FEW)
    most = popular.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    near = lambda some, deep: knn(targets, some, k + deep, True).select(F.col("query_id").alias("item_id"), F.col("item_id").alias("collection_id"), "cosine")
    ids = popular.select(F.col("item_id").alias("query_id"))
    far = near(asked.join(ids, "query_id", "left_anti"), OWN_FEW)
    far = far if not most else far.unionByName(near(asked.join(ids, "query_id", "left_semi"), most))
    far = far.join(mine, ["item_id", "collection_id"], "left_anti")
    inside = own.join(mine, "item_id").join(whole.filter("n > 1").select("collection_id", "sum"), "collection_id")
    rest = F.zip_with("sum", "v", lambda s, x: s - x)
    close = inside.select("item_id", "collection_id", F.round(dot(F.col("v"), l2_normalize(rest)), 9).alias("cosine")).filter("cosine IS NOT NULL")
    w = Window.partitionBy("item_id").orderBy(F.desc("cosine"), "collection_id")
    return far.unionByName(close).withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def stale_embeddings(vectors: DataFrame, items: DataFrame, model: str, dims: int) -> DataFrame:
    """``id`` of live items with a vector of another model or size."""
    odd = vectors.filter((F.col("model") != model) | (F.size("vector") != dims)).select(F.col("item_id").alias("id")).distinct()
    return odd.join(items.filter("NOT deleted").select("id"), "id")


def embedding_diff(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """``item_id`` of items whose wanted chunks (item_id, chunk, text_hash, model) are not just what exists."""
    both = existing.select("item_id", "chunk", F.col("text_hash").alias("h1"), F.col("model").alias("m1")).join(wanted.select("item_id", "chunk", F.col("text_hash").alias("h2"), F.col("model").alias("m2")), ["item_id", "chunk"], "full_outer")
    return both.filter(~(F.col("h1").eqNullSafe(F.col("h2")) & F.col("m1").eqNullSafe(F.col("m2")))).select("item_id").distinct()


def near_duplicates(items: DataFrame, title_key: Column, vectors: DataFrame | None = None, threshold: float = 0.95, mode: str = "lsh") -> DataFrame:
    """``a, b`` (a < b) of live items with one title key, domain and type, or of one type with summary vectors of cosine
    ``threshold`` or more. Ids may be of any type that has an order.

    Of each group by title, and of items of one type with equal vectors, the first is paired with each other: the rest
    follows from that, and a large group stays as many rows as it has members. Of different vectors every near pair is
    given: of those that share a bucket of hyperplanes (``mode`` "lsh"), or of all ("exact", quadratic)."""
    keyed = items.filter("NOT deleted").select("id", title_key.alias("title_key"), "domain", "type").filter("title_key <> ''")
    first = F.min("id").over(Window.partitionBy("title_key", "domain", "type"))
    titled = keyed.withColumn("a", first).filter("id <> a").select("a", F.col("id").alias("b"))
    if vectors is None:
        return titled
    live = items.filter("NOT deleted").select("id", F.col("type").alias("kind"))
    rows = vectors.filter("role = 'summary'").select(F.col("item_id").alias("id"), F.col("vector").cast("array<double>").alias("v")).join(live, "id")
    heads = rows.groupBy("kind", "v").agg(F.min("id").alias("id"))
    copies = rows.join(heads.withColumnRenamed("id", "a"), ["kind", "v"]).filter("id <> a").select("a", F.col("id").alias("b"), "v")
    zero = F.forall("v", lambda x: x == 0)
    return titled.unionByName(copies.filter(~zero).drop("v")).unionByName(near_pairs(heads, threshold, mode)).distinct()


def near_pairs(vectors: DataFrame, threshold: float, mode: str = "exact") -> DataFrame:
    """``a, b`` (a < b) of ``id, kind, v`` with one kind and size and cosine ``threshold`` or more.

    "exact": vectors are dealt into blocks by a hash of the id, and every block meets every block in a task of its own: a
    row is sent once a block, and a task holds two blocks however many rows a kind has. "lsh": the same within each
    bucket of as many hyperplanes that vectors of the threshold share one of ``TABLES`` with 95 %, up to 16 of them."""
    rows = vectors.filter("v IS NOT NULL AND size(v) > 0").select("id", "kind", "v")
    share = ["kind"]
    if mode == "lsh":
        side = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi  # two vectors of the threshold are on one side of a plane
        bits = max(1, min(16, int(math.log(1 - 0.05 ** (1 / TABLES)) / math.log(min(side, 0.999)))))
        rows, share = signed(rows, "v", TABLES, bits), ["kind", "table", "bucket"]
        blocks = rows.groupBy(*share).agg(F.ceil(F.count("*") / PAIR_BLOCK).alias("blocks"))
        rows = rows.join(blocks, share)
    else:
        rows = rows.withColumn("blocks", F.lit(max(1, -(-rows.count() // PAIR_BLOCK))))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    dealt = dealt.select("id", *share, "v", "block", F.size("v").alias("dims"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def meet(group: pa.Table) -> pa.Table:
        dims = group["dims"][0].as_py()
        values = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        norms = np.linalg.norm(values, axis=1)
        keep = np.flatnonzero(norms > 0)
        unit, ids = values[keep] / norms[keep, None], group["id"].combine_chunks().take(pa.array(keep))
        block, i, j = group["block"].to_numpy()[keep], group["i"][0].as_py(), group["j"][0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = [np.zeros((2, 0), np.int64)]
        for at in range(0, len(left), PAIR_ROWS):
            some = left[at : at + PAIR_ROWS]
            x, y = np.nonzero(np.round(unit[some] @ unit[right].T, 9) >= threshold)
            found.append(np.stack([some[x], right[y]]))
        a, b = np.concatenate(found, axis=1)
        return pa.table({"x": ids.take(pa.array(a[a != b])), "y": ids.take(pa.array(b[a != b]))})

    kind = vectors.schema["id"].dataType.simpleString()
    met = dealt.groupBy(*share, "dims", "i", "j").applyInArrow(meet, f"x {kind}, y {kind}")
    return met.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

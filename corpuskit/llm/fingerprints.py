"""Document fingerprints by invertible Bloom lookup sketches of paragraph digests. Only DataFrame functions.

A text is cut at line breaks, and long lines after the first sentence end beyond ``PART`` characters; the distinct
64-bit digests of these paragraphs are its set. A sketch has three tables of cells. A digest falls on one cell of
each; a cell keeps how many digests fell on it, the XOR of them and the XOR of their check values. Sketches of one
size subtract cell by cell, and what both texts have cancels. A cell that holds one digest gives it away, which takes
it out of its other cells, and so on until nothing is left: then the digests that only one of the texts has are
known. If something is left, a larger sketch is tried.

A fingerprint is the sketch of ``2^BASE_BITS`` cells a table. Comparing subtracts two fingerprints and peels them
within the row. Where that fails, the sketch takes a size that holds the digests of both texts, and as often as that
fails too, four times that under fresh hashes; these are cells in rows, summed by document. Likeness is the share of
the digests of both that both have: it follows from the two sizes and the recovered lists.

Defined results: a null text is an empty one; two texts without parts are alike (1.0); a null doc_id comes before all
others; rows that share an id have the same next document, and the first of them stands for it; a single document is
its own next; extra columns are ignored. The table must give its rows in the same order when it is read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import materialize

#: Cells of a table of a fingerprint, as a power of two; three tables.
BASE_BITS = 3
#: Rounds of peeling within a row, and steps (a table each) of peeling a larger sketch. Larger sketches are so sparse
#: that three steps leave a digest in a thousand sketches; few steps keep few sums in memory at a time.
ROW_ROUNDS, STEPS = 7, 4
#: Larger tries: cells a digest of either text gets, about, in the first and in those after it. One try in a thousand
#: fails, so a pair that fails all is no matter of chance.
CELLS, MORE_CELLS, TRIES = 24.0, 96.0, 12
#: Characters after which a line is cut at the next sentence end.
PART = 160
#: Bits of a digest that choose a cell of one table.
_SLICE = 21
_LEAST = -(1 << 63)
# One mark before the blank is enough, the lazy run takes those before it: it never looks back.
_PARTS = r"[^\n]{%d,}?[.!?](?=[ \t\n]|$)|[^\n]+" % PART


def digests(text: Column) -> Column:
    """The sorted distinct digests of the paragraphs of a text."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0)), lambda p: F.xxhash64(p))))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(77)).bitwiseAND(F.lit(0xFFFFFFFF))


def _cell(spread: Column, table: int, width: Column) -> Column:
    """Cell number of a digest in one table; numbers run on over the tables."""
    return F.shiftrightunsigned(spread, _SLICE * table).bitwiseAND(width - 1) + F.lit(table) * width


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _as_cell(n: Column, k: Column, h: Column) -> Column:
    return F.struct(n.alias("n"), k.alias("k"), h.alias("h"))


def sketch(keys: Column) -> Column:
    """The base sketch: an array of cells (n, k, h)."""
    width = 1 << BASE_BITS

    def cell(i: int) -> Column:
        here = F.filter(keys, lambda k: _cell(k, i // width, _long(width)) == i)
        return F.aggregate(here, _as_cell(_long(0), _long(0), _long(0)), lambda a, k: _as_cell(a["n"] + 1, a["k"].bitwiseXOR(k), a["h"].bitwiseXOR(_check(k))))

    return F.array(*[cell(i) for i in range(3 * width)])


def fingerprint(cells: Column) -> Column:
    """The base sketch as text: ``count:digests:checks`` in hexadecimal, cell by cell."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(":", F.hex(c["n"]), F.hex(c["k"]), F.hex(c["h"]))), ".")


def peeled(a: Column, b: Column) -> Column:
    """``only_a, only_b, left`` of the difference of two base sketches.

    Steps alternate: one lists the digests that lie alone in a cell, the next takes them out of all their cells."""
    width = 1 << BASE_BITS
    shift = lambda i: (F.floor(i / width) * _SLICE).cast("int")
    on = lambda k, i: F.call_function("shiftrightunsigned", k, shift(i)).bitwiseAND(_long(width - 1)) == i % width
    none = F.expr("CAST(array() AS array<struct<n: bigint, k: bigint>>)")
    minus = F.zip_with(a, b, lambda x, y: _as_cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"])))
    as_state = lambda cells, last, only_a, only_b: F.struct(cells.alias("cells"), last.alias("last"), only_a.alias("only_a"), only_b.alias("only_b"))

    def listed(s: Column) -> Column:
        alone = F.transform(s["cells"], lambda c, i: F.when((F.abs(c["n"]) == 1) & (c["h"] == _check(c["k"])) & on(c["k"], i), F.struct(c["n"].alias("n"), c["k"].alias("k"))))
        return as_state(s["cells"], F.array_distinct(F.filter(alone, lambda p: p.isNotNull())), s["only_a"], s["only_b"])

    def taken(s: Column) -> Column:
        out = lambda c, p: _as_cell(c["n"] - p["n"], c["k"].bitwiseXOR(p["k"]), c["h"].bitwiseXOR(_check(p["k"])))
        cells = F.transform(s["cells"], lambda c, i: F.aggregate(F.filter(s["last"], lambda p: on(p["k"], i)), c, out))
        count = lambda n: F.size(F.filter(s["last"], lambda p: p["n"] == n)).cast("long")
        return as_state(cells, none, s["only_a"] + count(1), s["only_b"] + count(-1))

    left = lambda s: F.size(F.filter(s["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["h"] != 0))).cast("long")
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(2 * ROW_ROUNDS)),
        as_state(minus, none, _long(0), _long(0)),
        lambda s, step: F.when(step % 2 == 1, listed(s)).otherwise(F.when(F.size(s["last"]) == 0, s).otherwise(taken(s))),
        lambda s: F.struct(s["only_a"].alias("only_a"), s["only_b"].alias("only_b"), left(s).alias("left")),
    )


def _decoded(pairs: DataFrame, cells_each: float, seed: int) -> DataFrame:
    """``uid, kind, n_a, n_b, only_a, only_b, left``: subtract and peel larger sketches. pairs: ``uid, kind, a, b``."""
    who = ["uid", "kind", "n_a", "n_b", "width"]
    # A digest becomes three cells and a document some hundred: small partitions keep their sums in memory.
    parts = 2 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.size("a") + F.size("b")
    bits = F.least(F.lit(_SLICE), F.greatest(F.lit(BASE_BITS), F.ceil(F.log2(size * (cells_each / 3.0))))).cast("int")
    signed = lambda c, n: F.transform(c, lambda k: F.struct(k.alias("k"), _long(n).alias("n")))
    entry = pairs.repartition(parts, "uid").select("uid", "kind", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"), F.pow(F.lit(2), bits).cast("long").alias("width"), F.explode(F.concat(signed("a", 1), signed("b", -1))).alias("e"))
    spots = entry.select(*who, "e.k", "e.n", _check(F.col("e.k")).alias("h"), F.explode(F.array(*[_cell(F.xxhash64(F.col("e.k"), F.lit(seed)), t, F.col("width")) for t in range(3)])).alias("c"))

    def summed(rows: DataFrame) -> DataFrame:
        cells = rows.groupBy(*who, "c").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
        return cells.filter((F.col("n") != 0) | (F.col("k") != 0) | (F.col("h") != 0))

    cells = summed(spots)
    as_row = lambda c, n, k, h: F.struct(c.cast("long").alias("c"), n.cast("long").alias("n"), k.alias("k"), h.alias("h"))
    for step in range(STEPS):
        # Within one table a digest has one cell, so no digest is found twice in a step.
        table = step % 3
        places = [_cell(F.xxhash64(F.col("k"), F.lit(seed)), t, F.col("width")) for t in range(3)]
        alone = (F.abs("n") == 1) & (F.col("c") == places[table]) & (F.col("h") == _check(F.col("k")))
        gone = [as_row(places[t], -F.col("n"), F.col("k"), F.col("h")) for t in range(3) if t != table]
        counted = as_row(F.when(F.col("n") == 1, -1).otherwise(-2), F.lit(1), _long(0), _long(0))  # cells -1 and -2 count what was found
        kept = as_row(F.col("c"), F.col("n"), F.col("k"), F.col("h"))
        cells = summed(cells.select(*who, F.explode(F.when(alone, F.array(*gone, counted)).otherwise(F.array(kept))).alias("x")).select(*who, "x.*"))
    found = lambda c: F.coalesce(F.sum(F.when(F.col("c") == c, F.col("n"))), _long(0))
    return cells.groupBy("uid", "kind", "n_a", "n_b").agg(found(-1).alias("only_a"), found(-2).alias("only_b"), F.sum((F.col("c") >= 0).cast("long")).alias("left"))


def _share(n_a: Column, n_b: Column, only_a: Column, only_b: Column) -> Column:
    """Common digests by digests of either text."""
    return F.when(n_a + only_b == 0, 1.0).otherwise((n_a - only_a) / (n_a + only_b))


def likeness(pairs: DataFrame) -> DataFrame:
    """``uid, kind, likeness`` of ``pairs`` (uid, kind, a, b), by larger sketches until every one is peeled."""
    done, left = None, pairs
    for attempt in range(TRIES):
        peeled_now = materialize(_decoded(left, MORE_CELLS if attempt else CELLS, 101 * (attempt + 1)), "peeled")
        share = _share(F.col("n_a"), F.col("n_b"), F.col("only_a"), F.col("only_b")).alias("likeness")
        settled = peeled_now.filter("left = 0").select("uid", "kind", share)
        done = settled if done is None else done.unionByName(settled)
        failed = peeled_now.filter("left > 0").select("uid", "kind")
        if failed.limit(1).count() == 0:
            return done
        # A merge join whatever the sizes: the failed pairs are few, but their number goes with the table.
        left = materialize(left.join(failed.hint("merge"), ["uid", "kind"]).select("uid", "kind", "a", "b"), "unpeeled")
    raise RuntimeError(f"digests that {TRIES} sketches do not tell apart")


def successors(base: DataFrame) -> DataFrame:
    """``prev, prev_n, key, head``: each id with the size of its longest row, the next larger id (the least after the
    last) and the first row of that. Ids are dealt by range; only the first id of each range meets the others."""
    ids = base.groupBy("key").agg(F.max("n_chars").alias("n"), F.min("uid").alias("uid"))
    ranged = materialize(ids.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ids")
    head = F.struct("key", "uid")
    within = ranged.withColumn("next", F.lead(head).over(Window.partitionBy("part").orderBy("key")))
    heads = ranged.groupBy("part").agg(F.min(head).alias("first"))
    by_part = Window.partitionBy(F.lit(0))
    after = heads.select("part", F.coalesce(F.lead("first").over(by_part.orderBy("part")), F.min("first").over(by_part)).alias("turn"))
    following = F.coalesce("next", "turn")
    return within.join(after, "part").select(F.col("key").alias("prev"), F.col("n").alias("prev_n"), following["key"].alias("key"), following["uid"].alias("head"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprints of each text and of its edited text, and how alike they, and the next text, are."""
    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    quarter = lambda n: F.floor(n / 4).cast("int")
    turn = successors(base.withColumn("n_chars", F.length("text")))
    # Not an equality of columns: both joins are then on the key alone and share the exchange of the texts.
    begun = base.join(turn, "key").filter("uid - head = 0").select(F.col("prev").alias("key"), F.substring("text", F.lit(1), quarter(F.col("prev_n"))).alias("beginning"), digests(F.col("text")).alias("d_next"))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter(n)), F.substring("beginning", F.lit(1), quarter(n)))
    slim = base.join(begun, "key").withColumn("edited", edited).select(
        "uid",
        F.when(F.col("key") != _LEAST, F.col("key")).alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digests(F.col("text")).alias("d_text"),
        digests(F.col("edited")).alias("d_edited"),
        "d_next",
    )
    cells = slim.select("*", *(sketch(F.col(f"d_{c}")).alias(f"c_{c}") for c in ("text", "edited", "next")))
    tried = cells.select(*slim.columns, *(peeled(F.col("c_text"), F.col(f"c_{c}")).alias(f"p_{c}") for c in ("edited", "next")))
    tried = materialize(tried, "digests")
    pair = lambda k, c: F.struct(F.lit(k).alias("kind"), F.col(f"d_{c}").alias("b"), F.col(f"p_{c}.left").alias("left"))
    pairs = tried.select("uid", F.col("d_text").alias("a"), F.explode(F.filter(F.array(pair(0, "edited"), pair(1, "next")), lambda p: p["left"] > 0)).alias("p")).select("uid", "p.kind", "a", "p.b")
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("likeness")))
    larger = materialize(likeness(pairs).groupBy("uid").agg(of(0).alias("l_edited"), of(1).alias("l_next")), "likeness")
    rows = tried.join(larger, "uid", "left")

    def near(c: str) -> Column:
        small = _share(F.size("d_text"), F.size(f"d_{c}"), F.col(f"p_{c}.only_a"), F.col(f"p_{c}.only_b"))
        return F.coalesce(F.col(f"l_{c}"), small).alias(f"near_{c}")

    printed = lambda c: fingerprint(sketch(F.col(f"d_{c}")))
    return rows.select("doc_id", "n_chars", "edited_sha256", printed("text").alias("fingerprint"), printed("edited").alias("edited_fingerprint"), near("edited"), near("next"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))

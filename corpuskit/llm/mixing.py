"""Mixing sources to target weights by hash-threshold histograms. Only DataFrame functions.

Every document has a fixed 60-bit hash of its id and text. A source that should give ``target`` tokens gives every document
``floor(target / size)`` times, and those under a hash threshold once more, so a larger budget takes a superset of
what a smaller one takes. The threshold is found from sums by source and hash bucket; only the bucket in which the
budget ends is looked at again, with finer buckets, down to a single hash. Where several rows have it (they agree in
id and text, so in size), the budget takes as many of them as it holds: they are counted by partition of the table,
and only the rows of the partition in which the count ends are numbered. No other document is sorted.

Defined results: a null text has size 0; a null source is a source of its own, last in order; ids may be null or
repeat; of rows that agree in id and text any are taken once more, and how many does not depend on their order; an
empty table gives an empty result; other columns pass through. The table must give its rows in the same order when it
is read again, as files do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import WORD, materialize

#: Bits of the hash that each pass looks at, from the top: two rounds of buckets, then single hash values.
LEVELS = (16, 16, 28)
BITS = sum(LEVELS)
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Parts that each source's rows are dealt into for the join with its threshold.
SALTS = 128
#: Bits of a row's number that count within its partition.
PART_BITS = 33
_MOST = (1 << 63) - 1


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def hash60(doc_id: Column, text: Column) -> Column:
    """The first 15 hexadecimal digits of the MD5 of the id as text, a line break and the text."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row a source: ``source, source_size, weight, target``. Targets share the total by weight, none above
    ``max_repeats`` times its source's size; what that leaves over is shared again among the rest.

    The windows run over one row a source. In the order of size by weight the capped sources come first, so the
    share of the others follows from running sums."""
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    by_ratio = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    choices = F.array(*[F.lit(int(w)) for w in weights])
    total, before, open_weight = F.col("total"), F.col("before"), F.col("open_weight")
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(choices, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("before", F.sum("cap").over(by_ratio) - F.col("cap"))
        .withColumn("open_weight", F.sum("weight").over(every) - F.sum("weight").over(by_ratio) + F.col("weight"))
        .withColumn("share", (total - before).cast("double") * F.col("weight").cast("double") / open_weight.cast("double"))
        .withColumn("capped", F.col("share") >= F.col("cap").cast("double"))
        .withColumn("rest", F.max(F.when(~F.col("capped"), total - before)).over(every))
        .withColumn("rest_weight", F.max(F.when(~F.col("capped"), open_weight)).over(every))
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("rest").cast("double") * F.col("weight").cast("double") / F.col("rest_weight").cast("double")))
        .select("source", "source_size", "weight", "target")
    )


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a source: ``source, source_size, target, repeats, threshold, last``; a document is taken ``repeats``
    times, and once more if its hash is below ``threshold``, or is that and its ``uid`` is at most ``last``."""
    size = F.col("source_size").cast("double")
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    plan = targets.select("source", "source_size", "target", repeats.alias("repeats")).withColumn("budget", F.round(F.col("target") - F.col("repeats") * size).cast("long"))
    plan = materialize(plan, "mix-state")
    state = plan.select(F.col("source").alias("s_source"), F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"))
    done_bits = 0
    for level, bits in enumerate(LEVELS):
        shift = BITS - done_bits - bits
        inside = sized if level == 0 else _within(sized, state, F.shiftright("hash", shift + bits))
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("tokens"))
        state = materialize(_crossed(sums, state, "tokens"), "mix-state")  # a row a source: no plan grows with the levels
        done_bits += bits
    # One hash is left of each source. Its rows have one size: the budget takes the whole number nearest to what is left.
    ties = _within(sized, state, F.col("hash")).filter("size > 0").select("source", "uid", "size", F.shiftrightunsigned("uid", PART_BITS).alias("part"))
    counts = ties.groupBy("source", "part").agg(F.count("*").alias("rows"), F.min("size").alias("each"))
    wanted = counts.groupBy("source").agg(F.min("each").alias("each")).join(state, F.col("source").eqNullSafe(F.col("s_source")))
    wanted = wanted.select("s_source", F.col("prefix").alias("threshold"), F.floor((F.col("left") * 2 + F.col("each")) / (F.col("each") * 2)).alias("left"))
    wanted = materialize(wanted, "mix-state")
    part = _crossed(counts.select("source", F.col("part").alias("bucket"), "rows"), wanted.select("s_source", "left"), "rows")
    part = materialize(part, "mix-state")
    numbered = _within(ties, part, F.col("part")).withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("uid")))
    ends = numbered.join(part.select(F.col("s_source").alias("e_source"), "left"), F.col("source").eqNullSafe(F.col("e_source")) & (F.col("nth") == F.col("left") + 1))
    cut = wanted.join(ends.select("e_source", F.col("uid").alias("stop")), F.col("s_source").eqNullSafe(F.col("e_source")), "left")
    # Rows before the first that is not taken; without such a row all of them are.
    last = F.coalesce(F.col("stop") - 1, F.lit(_MOST))
    ended = cut.select("s_source", "threshold", last.alias("last"))
    # A budget that no bucket crosses is nothing, or all of its source.
    return plan.join(ended, F.col("source").eqNullSafe(F.col("s_source")), "left").select("source", "source_size", "target", "repeats", F.coalesce("threshold", F.when(F.col("budget") > 0, 1 << BITS).otherwise(-1)).alias("threshold"), F.coalesce("last", F.lit(-1)).alias("last"))


def _within(rows: DataFrame, state: DataFrame, prefix: Column) -> DataFrame:
    """The rows in the bucket in which the budget of their source ends."""
    return rows.join(state.select("s_source", F.col("prefix").alias("s_prefix")), F.col("source").eqNullSafe(F.col("s_source")) & (prefix == F.col("s_prefix"))).select(*rows.columns)


def _crossed(sums: DataFrame, state: DataFrame, column: str) -> DataFrame:
    """``s_source, left, prefix``: the bucket in which what is left of a budget ends, and what is left for it."""
    below = F.sum(column).over(Window.partitionBy("source").orderBy("bucket")) - F.col(column)
    return (
        sums.withColumn("below", below)
        .join(state.select("s_source", "left"), F.col("source").eqNullSafe(F.col("s_source")))
        .filter((F.col("below") <= F.col("left")) & (F.col("left") < F.col("below") + F.col(column)))
        .select("s_source", (F.col("left") - F.col("below")).alias("left"), F.col("bucket").alias("prefix"))
    )


def _planned(docs: DataFrame, weights: tuple[int, ...], max_repeats: int) -> tuple[DataFrame, DataFrame]:
    """The slim table of documents, and the plan of each source once for every salt."""
    uid = F.monotonically_increasing_id().alias("uid")
    sized = materialize(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), hash60(F.col("doc_id"), F.col("text")).alias("hash"), uid), "mix-sizes")
    cuts = materialize(thresholds(sized, source_targets(sized, weights, max_repeats)), "mix-thresholds")
    return sized, cuts.withColumnRenamed("source", "c_source").withColumn("c_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _with_copies(hashed: DataFrame, salted: DataFrame, max_repeats: int) -> DataFrame:
    here = F.col("source").eqNullSafe(F.col("c_source")) & ((F.col("hash") % SALTS).cast("int") == F.col("c_salt"))
    once_more = F.col("worded") & ((F.col("hash") < F.col("threshold")) | ((F.col("hash") == F.col("threshold")) & (F.col("uid") <= F.col("last"))))
    return hashed.join(salted, here).withColumn("copies", F.least(F.lit(max_repeats).cast("long"), F.col("repeats") + F.when(once_more, 1).otherwise(0)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per document ``doc_id, source, size, source_size, target, copies, taken``: the mix takes it ``copies`` times."""
    sized, salted = _planned(docs, weights, max_repeats)
    return _with_copies(sized.withColumn("worded", F.col("size") > 0), salted, max_repeats).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it, with the columns of ``docs``. A document without
    words adds nothing to a mix of words and is kept once."""
    _, salted = _planned(docs, weights, max_repeats)
    hashed = docs.select(F.struct(*docs.columns).alias("doc"), "source", hash60(F.col("doc_id"), F.col("text")).alias("hash"), F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col("text"), F.lit("")).rlike(WORD).alias("worded"))
    times = F.when(F.col("worded"), F.col("copies").cast("int")).otherwise(1)
    return _with_copies(hashed, salted, max_repeats).withColumn("times", times).filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || chr(10) || coalesce(text, '')), 1, 15) AS BIGINT) AS hash
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight, source_size * 3 AS cap FROM sources
), running AS (
  SELECT *, sum(source_size) OVER () AS total,
         sum(cap) OVER r - cap AS before,
         sum(weight) OVER () - sum(weight) OVER r + weight AS open_weight
  FROM weighed WINDOW r AS (ORDER BY CAST(cap AS DOUBLE) / weight, source ASC NULLS LAST)
), capped AS (
  SELECT *, CAST(total - before AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(open_weight AS DOUBLE) >= CAST(cap AS DOUBLE) AS capped FROM running
), rest AS (
  SELECT *, max(CASE WHEN NOT capped THEN total - before END) OVER () AS rest,
         max(CASE WHEN NOT capped THEN open_weight END) OVER () AS rest_weight FROM capped
), targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(rest AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(rest_weight AS DOUBLE) END AS target
  FROM rest
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM targets
), placed AS (
  SELECT s.doc_id, s.source, s.size, b.source_size, b.target, b.repeats,
         CAST(round(b.target - b.repeats * CAST(b.source_size AS DOUBLE)) AS BIGINT) AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash RANGE UNBOUNDED PRECEDING) - sum(s.size) OVER (PARTITION BY s.source, s.hash) AS below,
         row_number() OVER (PARTITION BY s.source, s.hash) AS nth
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
), counted AS (
  SELECT *, least(3, repeats + CASE WHEN size > 0 AND (budget - below) * 2 + size >= 2 * size * nth THEN 1 ELSE 0 END) AS copies FROM placed
)
SELECT doc_id, source, size, source_size, target, copies, size * copies AS taken FROM counted
"""

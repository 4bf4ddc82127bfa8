"""Counts, overviews and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words that keyword lists leave out.
KEYWORD_STOPWORDS = (
    "a an the and or but if then else of to in on at by for with from as is are was were be been being this that these those "
    "it its it's into over under about after before between during through up down out off again further once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very can will "
    "just should now you your yours we our ours they them their he she his her i me my mine what which who whom whose have has "
    "had do does did done also via using use used new one two three like get got make made per may might must shall would "
    "could title type url domain mime captured content metadata json children attached image images item items candidates "
    "existing collections question today action instruction selected read finish kind note answer https http www com"
).split()


def stats(items: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row: live items, live top-level items, edges, collections."""
    a = items.agg(F.count_if(~F.col("deleted")).alias("n_items"), F.count_if((~F.col("deleted")) & F.col("parent_id").isNull()).alias("n_top"))
    b = edges.agg(F.count("*").alias("n_edges"))
    c = members.agg(F.count_distinct("collection_id").alias("n_collections"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def counts_by(items: DataFrame, *cols: str) -> DataFrame:
    return items.filter("NOT deleted").groupBy(*cols).agg(F.count("*").alias("n"))


def collection_summaries(members: DataFrame, items: DataFrame, covers: int = 4) -> DataFrame:
    """``collection_id, n, covers``: live members and the newest of them."""
    live = members.join(items.filter("NOT deleted").select(F.col("id").alias("item_id"), "captured_s"), "item_id")
    w = Window.partitionBy("collection_id").orderBy(F.desc("captured_s"), "item_id")
    counts = live.groupBy("collection_id").agg(F.count("*").alias("n"))
    top = live.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= covers)
    lists = top.groupBy("collection_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item_id"))), lambda x: x["item_id"]).alias("covers"))
    return members.select("collection_id").distinct().join(counts, "collection_id", "left").join(lists, "collection_id", "left").select("collection_id", F.coalesce("n", F.lit(0)).alias("n"), "covers")


def topic_overview(topics: DataFrame, limit: int = 15, examples: int = 3) -> DataFrame:
    """``topic, n, examples`` of ``id, topic``: the most frequent topics and their first items."""
    named = topics.select("id", F.lower("topic").alias("topic")).distinct()
    top = named.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(limit)
    w = Window.partitionBy("topic").orderBy("id")
    some = named.join(top, "topic").withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= examples)
    return some.groupBy("topic", "n").agg(F.array_sort(F.collect_list("id")).alias("examples"))


def keywords(docs: DataFrame, k: int = 6) -> DataFrame:
    """``id, word, n, pos``: the most frequent words of three letters or more, no stopwords, no numbers; ties by place."""
    words = docs.select("id", F.posexplode(F.filter(F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z0-9+#.\-]+"), lambda w: F.regexp_replace(w, r"^[.\-]+|[.\-]+$", "")), lambda w: w != "")).alias("at", "word"))
    kept = words.filter((F.length("word") >= 3) & ~F.col("word").isin(KEYWORD_STOPWORDS) & ~F.col("word").rlike(r"^\d+$"))
    counts = kept.groupBy("id", "word").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    w = Window.partitionBy("id").orderBy(F.desc("n"), "at")
    return counts.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k).select("id", "word", "n", "pos")


def entities(docs: DataFrame, k: int = 8) -> DataFrame:
    """``id, name, pos``: distinct capitalised names of three letters or more, in order of appearance. The pattern gives
    nothing back once matched, so that names of any number of words are matched in a loop."""
    found = docs.select("id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9]++(?!_)(?:[ -][A-Z][A-Za-z0-9]++(?!_))*+)"), F.lit(1))).alias("at", "name"))
    kept = found.filter((F.length("name") >= 3) & ~F.lower("name").isin(KEYWORD_STOPWORDS)).groupBy("id", "name").agg(F.min("at").alias("at"))
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("at"))).filter(F.col("pos") <= k).select("id", "name", "pos")


def run_evidence(steps: DataFrame) -> DataFrame:
    """``run_id, looked, read, writes`` of ``run_id, step, kind, item_id``: distinct items by kind of step, and writes."""
    return steps.groupBy("run_id").agg(F.count_distinct("item_id").alias("looked"), F.count_distinct(F.when(F.col("kind") == "read", F.col("item_id"))).alias("read"), F.count_if(F.col("kind") == "write").alias("writes"))


def run_items(steps: DataFrame) -> DataFrame:
    """``run_id, item_id, nth``: items of a run in the order in which they were first seen."""
    first = steps.groupBy("run_id", "item_id").agg(F.min("step").alias("step"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("run_id").orderBy("step", "item_id"))).select("run_id", "item_id", "nth")


def usage_totals(steps: DataFrame) -> DataFrame:
    """``run_id, calls, chars, p50`` of ``run_id, chars``."""
    return steps.groupBy("run_id").agg(F.count("*").alias("calls"), F.sum("chars").alias("chars"), F.median("chars").alias("p50"))


def run_usage(calls: DataFrame) -> DataFrame:
    """``run_id, task, calls, prompt, completion, latency_ms, p50_ms, p90_ms`` of calls with ``run_id, task, prompt,
    completion`` (tokens) and ``latency_ms``: sums, and the middle and the ninth tenth of the latencies; what is null
    adds nothing."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return calls.groupBy("run_id", "task").agg(F.count("*").alias("calls"), total("prompt"), total("completion"), total("latency_ms"), F.percentile("latency_ms", 0.5).alias("p50_ms"), F.percentile("latency_ms", 0.9).alias("p90_ms"))


def member_overlap(members: DataFrame) -> DataFrame:
    """``a, b, shared, ratio``: common members of two collections by the size of the first."""
    m = members.select("collection_id", "item_id").distinct()
    pairs = m.withColumnRenamed("collection_id", "a").join(m.withColumnRenamed("collection_id", "b"), "item_id").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    sizes = m.groupBy(F.col("collection_id").alias("a")).agg(F.count("*").alias("size"))
    return pairs.join(sizes, "a").select("a", "b", "shared", (F.col("shared") / F.col("size")).alias("ratio"))

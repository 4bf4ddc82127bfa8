"""Stage results: the latest by item and stage, what is open, and the status they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The stages of a text item and what each waits for.
STAGE_GRAPH = (("extract", ()), ("embed", ("extract",)), ("understand", ("extract",)), ("index", ("embed", "understand")), ("relate", ("index",)))


def latest_stage(events: DataFrame) -> DataFrame:
    """``item_id, stage, outcome, at_us``: the last result of each stage of each item."""
    last = events.groupBy("item_id", "stage").agg(F.max(F.struct("at_us", "seq", "outcome")).alias("e"))
    return last.select("item_id", "stage", "e.outcome", "e.at_us")


def pending_stages(events: DataFrame) -> DataFrame:
    """``item_id, stage``: stages that have no result yet while all they wait for have one."""
    spark = events.sparkSession
    needs = spark.createDataFrame([(s, n) for s, ns in STAGE_GRAPH for n in ns], "stage string, need string")
    sizes = spark.createDataFrame([(s, len(ns)) for s, ns in STAGE_GRAPH if ns], "stage string, n int")
    done = events.select("item_id", "stage").distinct()
    met = done.join(F.broadcast(needs), F.col("need") == done["stage"]).groupBy("item_id", needs["stage"].alias("next")).agg(F.count("*").alias("met"))
    ready = met.join(F.broadcast(sizes), (met["next"] == sizes["stage"]) & (met["met"] == sizes["n"])).select("item_id", F.col("next").alias("stage"))
    return ready.join(done, ["item_id", "stage"], "left_anti")


def backlog_head(events: DataFrame) -> DataFrame:
    """The oldest failed result of each stage: what would be tried again first."""
    w = Window.partitionBy("stage").orderBy("at_us", "seq")
    return latest_with_seq(events).filter("outcome = 'failed'").withColumn("r", F.row_number().over(w)).filter("r = 1").select("stage", "item_id", "at_us")


def latest_with_seq(events: DataFrame) -> DataFrame:
    last = events.groupBy("item_id", "stage").agg(F.max(F.struct("at_us", "seq", "outcome")).alias("e"))
    return last.select("item_id", "stage", "e.seq", "e.outcome", "e.at_us")


def batch_ready(items: DataFrame, events: DataFrame) -> DataFrame:
    """``batch_id, ready``: whether all live items of a batch that are no notes have been indexed."""
    indexed = events.filter("stage = 'index'").select(F.col("item_id").alias("id")).distinct().withColumn("done", F.lit(True))
    rows = items.filter("NOT deleted AND type <> 'note'").join(indexed, "id", "left")
    return rows.groupBy("batch_id").agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("ready"))


def next_status(status: Column, stage: Column, outcome: Column, last: Column) -> Column:
    """The transition table: status after a stage's outcome; ``last`` says that no stage follows."""
    settled = F.when((outcome == "partial") | status.isin("EXTRACTION_FAILED", "PARTIAL"), "PARTIAL").otherwise("READY")
    keep_or_settle = F.when(~last, status).otherwise(F.when(outcome == "failed", "PARTIAL").otherwise(settled))
    return (
        F.when(stage == "extract", F.when(outcome == "failed", "EXTRACTION_FAILED").otherwise("EXTRACTED"))
        .when(stage == "embed", F.when((outcome != "failed") & status.isin("CAPTURED", "EXTRACTING", "EXTRACTED", "EMBEDDING"), "UNDERSTANDING").otherwise(status))
        .when(stage == "understand", F.when(outcome == "failed", "AI_FAILED").when(outcome == "partial", "PARTIAL").otherwise(F.when(status == "EXTRACTION_FAILED", "PARTIAL").otherwise("RELATING")))
        .when(stage == "relate", F.when(outcome == "failed", "AI_FAILED").otherwise(settled))
        .otherwise(keep_or_settle)
    )


def status_fold(events: DataFrame) -> DataFrame:
    """``item_id, status, n``: the status that an item's results lead to, in order of (time, sequence)."""
    ordered = events.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at_us", "seq", "stage", "outcome"))).alias("e"))
    fold = F.aggregate("e", F.lit("CAPTURED"), lambda s, e: next_status(s, e["stage"], e["outcome"], F.lit(False)))
    return ordered.select("item_id", fold.alias("status"), F.size("e").cast("long").alias("n"))

"""Streaming twins: each takes a streaming DataFrame and gives one, or a sink for ``foreachBatch``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuskit.operators import index as index_ops
from corpuskit.operators import vectors
from corpuskit.operators.preparation import chunk_bodies
from corpuskit.sources.tables import written
from corpuskit.streaming.segments import Segments
from corpuskit.streaming.stateful import group_complete, mark_repeats

__all__ = ["group_complete", "index_sink", "mark_repeats", "next_status", "progress_stream", "read_index", "read_table", "read_vectors", "status_stream", "stream_dedupe", "stream_within", "table_sink", "vector_sink"]


def stream_dedupe(captures: DataFrame, key: str, time: str = "ts", within: str = "30 days") -> DataFrame:
    """The first capture of each key; repeats that come within the watermark are dropped, so state stays bounded."""
    return captures.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def progress_stream(results: DataFrame) -> DataFrame:
    """Live counts by stage and outcome, for the update or complete mode."""
    return results.groupBy("stage", "outcome").agg(F.count("*").alias("n"))


def stream_within(a: DataFrame, b: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """``a_id, b_id``: captures of the same user within ``minutes`` of each other (user_id, id, ts), on watermarks."""
    left = a.select(F.col("user_id").alias("a_user"), F.col("id").alias("a_id"), F.col("ts").alias("a_ts")).withWatermark("a_ts", late)
    right = b.select(F.col("user_id").alias("b_user"), F.col("id").alias("b_id"), F.col("ts").alias("b_ts")).withWatermark("b_ts", late)
    gap = f"INTERVAL {int(minutes)} MINUTES"
    near = F.expr(f"a_user = b_user AND b_ts BETWEEN a_ts - {gap} AND a_ts + {gap} AND a_id < b_id")
    return left.join(right, near).select("a_id", "b_id")


def next_status(status: str, stage: str, outcome: str) -> str:
    """One step of the transition table, as the batch fold has it."""
    settled = "PARTIAL" if outcome == "partial" or status in ("EXTRACTION_FAILED", "PARTIAL") else "READY"
    if stage == "extract":
        return "EXTRACTION_FAILED" if outcome == "failed" else "EXTRACTED"
    if stage == "embed":
        return "UNDERSTANDING" if outcome != "failed" and status in ("CAPTURED", "EXTRACTING", "EXTRACTED", "EMBEDDING") else status
    if stage == "understand":
        return {"failed": "AI_FAILED", "partial": "PARTIAL"}.get(outcome, "PARTIAL" if status == "EXTRACTION_FAILED" else "RELATING")
    if stage == "relate":
        return "AI_FAILED" if outcome == "failed" else settled
    return status


def status_stream(results: DataFrame) -> DataFrame:
    """``item_id, status, n`` after each batch of ``item_id, at_us, seq, stage, outcome``; the state is one row an item.

    Results of one batch are taken in the order of (at_us, seq); one that comes in a later batch counts as later."""

    def fold(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n = state.get if state.exists else ("CAPTURED", 0)
        rows = pd.concat(list(parts)).sort_values(["at_us", "seq"])
        for stage, outcome in zip(rows["stage"], rows["outcome"], strict=True):
            status, n = next_status(status, stage, outcome), n + 1
        state.update((status, n))
        yield pd.DataFrame({"item_id": [key[0]], "status": [status], "n": [n]})

    return results.groupBy("item_id").applyInPandasWithState(fold, "item_id long, status string, n long", "status string, n long", "update", GroupStateTimeout.NoTimeout)


def table_sink(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the rows of a batch replace those of their keys in the table at ``path``. ``read_table``
    gives the table. A repeated batch gives the same table; old folders are merged and removed as batches come."""

    def write(batch: DataFrame, batch_id: int) -> None:
        Segments(batch.sparkSession, path, keys).write(batch_id, {"rows": batch}, batch)

    return write


def read_table(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The table that ``table_sink`` keeps: of each key the rows of the last batch that had it."""
    return Segments(spark, path, keys).read("rows")


def index_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over changed ``id, field, text``: keeps the index at ``path``, which ``read_index`` gives. A
    batch has all fields of the items that it changes; an item whose texts are all null is taken out. Only changed items
    are tokenised and written."""

    def write(batch: DataFrame, batch_id: int) -> None:
        raw = index_ops.postings_of(index_ops.gathered(batch.filter("text IS NOT NULL")))
        Segments(batch.sparkSession, path, ["id"]).write(batch_id, {"postings": raw}, batch)

    return write


def read_index(spark: SparkSession, path: str) -> index_ops.Index:
    return index_ops.index_of(Segments(spark, path, ["id"]).read("postings"))


def vector_sink(path: str, model: str, embed: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over changed ``id, text`` (null: the item goes): keeps ``item_id, chunk, text_hash, model,
    vector`` of all chunks of the texts. Items whose chunks are what is stored already are not embedded again.

    embed: ``id, text`` to ``id, vector``; hashed vectors where none is given."""
    embed = embed or vectors.hash_embed

    def write(batch: DataFrame, batch_id: int) -> None:
        store = Segments(batch.sparkSession, path, ["item_id"])
        texts = batch.select("id", "text").filter("text IS NOT NULL")
        wanted = chunk_bodies(texts, max_chunks=None).select(F.col("id").alias("item_id"), "chunk", F.sha2("text", 256).alias("text_hash"), F.lit(model).alias("model"), "text")
        changed = batch.select(F.col("id").alias("item_id")).distinct()
        if store.version(batch_id)[0] >= 0:
            known = store.read("vectors").join(changed, "item_id", "left_semi")
            empty = batch.join(texts.select("id"), "id", "left_anti").select(F.col("id").alias("item_id"))
            changed = written(vectors.embedding_diff(known, wanted).unionByName(empty).distinct(), "changed")
        fresh = written(wanted.join(changed, "item_id", "left_semi").withColumn("key", F.struct("item_id", "chunk")), "fresh")
        made = embed(fresh.select(F.col("key").alias("id"), "text")).select(F.col("id").alias("key"), "vector")
        rows = fresh.join(made, "key").select("item_id", "chunk", "text_hash", "model", "vector")
        store.write(batch_id, {"vectors": rows}, changed)

    return write


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return Segments(spark, path, ["item_id"]).read("vectors")



"""Registered streaming queries: the event log read as a file stream until it ends, the result read back as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.plans import item_queries, model
from corpuskit.plans.catalog import query
from corpuskit.sources.tables import scratch
from corpuskit.streaming import streams


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = model.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(frame: DataFrame, mode: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Run the stream to its end. Appended rows all stay; of updates the last of each key, of complete results the last."""
    spark, at = frame.sparkSession, scratch(frame.sparkSession, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{at}/out/batch={batch_id}")

    frame.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    out = spark.read.schema(frame.schema.add("_batch", "long")).parquet(f"{at}/out/*")
    if mode == "append":
        return out.drop("_batch")
    last = F.max("_batch").over(Window.partitionBy(*keys)) if keys else F.lit(out.agg(F.max("_batch")).first()[0])
    return out.withColumn("_last", last).filter("_batch = _last").drop("_batch", "_last")


@query("stream_dedupe", "SELECT DISTINCT user_id FROM events")
def stream_dedupe(spark, sf_dir):
    return _drain(streams.stream_dedupe(_events(spark, sf_dir), "user_id", within="3650 days").select("user_id"), "append", "stream-dedupe")


@query("progress_stream", f"WITH {model.STAGE_EVENTS} SELECT stage, outcome, count(*) AS n FROM stage_events GROUP BY ALL")
def progress_stream(spark, sf_dir):
    return _drain(streams.progress_stream(model.as_stage_events(_events(spark, sf_dir))), "complete", "stream-progress")


@query("status_stream", item_queries.STATUS_FOLD)
def status_stream(spark, sf_dir):
    return _drain(streams.status_stream(model.as_stage_events(_events(spark, sf_dir))), "update", "stream-status", ["item_id"])


@query("group_complete", f"""WITH {model.STAGE_EVENTS}, e AS (SELECT item_id, item_id // 4 AS batch_id, 1 + (item_id // 4) % 4 AS size, at_us // 1000 AS at_ms FROM stage_events WHERE stage = 'index'),
i AS (SELECT batch_id, size, item_id, min(at_ms) AS at_ms FROM e GROUP BY ALL), o AS (SELECT *, row_number() OVER w AS nth, min(at_ms) OVER (PARTITION BY batch_id) AS first FROM i WINDOW w AS (PARTITION BY batch_id ORDER BY at_ms, item_id)),
b AS (SELECT batch_id, any_value(size) AS size, any_value(first) AS first, count(*) AS n, count(*) FILTER (WHERE at_ms <= first + 259200000) AS early FROM o GROUP BY batch_id),
m AS (SELECT max(at_ms) - 86400000 AS mark FROM e)
SELECT batch_id, size AS items, CASE WHEN size = 1 THEN 'single' ELSE 'complete' END AS reason FROM b WHERE early >= size
UNION ALL SELECT batch_id, early, 'gate' FROM b, m WHERE early < size AND (n > early OR first + 259200000 < mark)
UNION ALL SELECT batch_id, 1, 'late' FROM (SELECT batch_id, unnest(range(n - least(early, size))) FROM b)""")
def group_complete(spark, sf_dir):
    """Batches of one to four items that go because all are indexed, or three days after the first; items after that."""
    indexed = model.as_stage_events(_events(spark, sf_dir)).filter("stage = 'index'")
    batch = F.floor(F.col("item_id") / 4).cast("long")
    events = indexed.select(batch.alias("batch_id"), "item_id", (1 + batch % 4).alias("size"), F.timestamp_micros("at_us").alias("ts"))
    return _drain(streams.group_complete(events, gate_s=72 * 3600, late="1 day"), "append", "stream-groups").withColumn("items", F.col("items").cast("long"))


@query("mark_repeats", "SELECT event_id, user_id, first_value(event_id) OVER w AS first_id, event_id <> first_value(event_id) OVER w AS repeated, epoch_us(max(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS kept_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def mark_repeats(spark, sf_dir):
    """Captures of one user as repeats of the user's first one, and when the user's was last kept."""
    captures = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts")
    out = _drain(streams.mark_repeats(captures, "3650 days"), "append", "stream-repeats")
    return out.select(F.col("id").alias("event_id"), F.col("key").alias("user_id"), "first_id", "repeated", F.unix_micros("kept_at").alias("kept_us"))


def _feed(docs, sink, name, turns):
    """Runs a stream over files that come turn by turn (column ``turn``), each turn a batch."""
    spark, at = docs.sparkSession, scratch(docs.sparkSession, name)
    for turn in range(turns):
        docs.filter(F.col("turn") == turn).drop("turn").write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(docs.drop("turn").schema).parquet(f"{at}/in")
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()


@query("index_upkeep", r"""WITH texts AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 4 THEN NULL WHEN doc_id % 3 = 0 THEN text || ' changed again' ELSE text END AS text FROM documents),
tok AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM texts)
SELECT term, id, count(*) AS tf FROM tok GROUP BY ALL""")
def index_upkeep(spark, sf_dir):
    """The index of a stream of seven batches: all texts in four, changes of every third item in two, then every ninth
    goes. Merges have left few segments by then; the postings are those of a rebuild."""
    docs = model.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("extracted_text").alias("field"), "text")
    i = F.col("id")
    first = docs.withColumn("turn", i % 4)
    more = docs.filter(i % 3 == 0).withColumns({"text": F.concat("text", F.lit(" changed again")), "turn": 4 + i % 2})
    gone = docs.filter(i % 9 == 4).withColumns({"text": F.lit(None).cast("string"), "turn": F.lit(6)})
    at = scratch(spark, "kept-index")
    _feed(first.unionByName(more).unionByName(gone), streams.index_sink(at), "index-turns", 7)
    return streams.read_index(spark, at).postings.select("term", "id", "tf")

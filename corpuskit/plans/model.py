"""Limits, and the engine's tables as views of the test tables (the SQL twins feed the oracles)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Defaults of the operators, all of them parameters there."""

    text_chars: int = 60_000
    excerpt: int = 280
    chunk_chars: int = 1800
    max_chunks: int = 24
    cosine_floor: float = 0.5
    near_duplicate: float = 0.95
    membership_confidence: float = 0.7
    leg: int = 40
    rrf_k: int = 60


LIMITS = Limits()
#: The time that queries over the test tables take as now, in epoch seconds.
NOW = 1_706_745_600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept objects from ``documents``; times in epoch seconds."""
    d = F.col("doc_id")
    pick = lambda n, names: F.element_at(F.array(*map(F.lit, names)), (d % n + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        d.alias("id"),
        pick(6, ("url", "pdf", "text", "markdown", "image", "note")).alias("type"),
        pick(5, ("article", "paper", "docs", "library", "note")).alias("kind"),
        F.trim(F.regexp_replace(F.substring("text", 1, 60), r"[ \t\r\n]+", " ")).alias("title"),
        F.concat("source", F.lit(".example.org")).alias("domain"),
        F.col("text").alias("extracted_text"),
        "lang",
        (F.lit(1_704_067_200) + d * 2220).alias("captured_s"),
        F.floor(d / 4.0).cast("long").alias("batch_id"),
        F.when(d % 7 == 3, d - 3).alias("parent_id"),
        (d % 11 == 10).alias("deleted"),
    )


ITEMS = r"""items AS (
  SELECT doc_id AS id,
    CASE doc_id % 6 WHEN 0 THEN 'url' WHEN 1 THEN 'pdf' WHEN 2 THEN 'text' WHEN 3 THEN 'markdown' WHEN 4 THEN 'image' ELSE 'note' END AS type,
    CASE doc_id % 5 WHEN 0 THEN 'article' WHEN 1 THEN 'paper' WHEN 2 THEN 'docs' WHEN 3 THEN 'library' ELSE 'note' END AS kind,
    trim(regexp_replace(substring(text, 1, 60), '[ \t\r\n]+', ' ', 'g')) AS title,
    concat(source, '.example.org') AS domain, text AS extracted_text, lang,
    1704067200 + doc_id * 2220 AS captured_s, CAST(floor(doc_id / 4.0) AS BIGINT) AS batch_id,
    CASE WHEN doc_id % 7 = 3 THEN doc_id - 3 END AS parent_id, doc_id % 11 = 10 AS deleted
  FROM documents)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, tokens``: the words of each benchmark text, distinct."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(words).alias("tokens"))


QUERY_TOKENS = r"""q_tokens AS (
  SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM benchmark)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, chunk, role, model, vector``: three chunks an item, the first its summary."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(v / 3).cast("long").alias("item_id"),
        (v % 3).cast("int").alias("chunk"),
        F.when(v % 3 == 0, "summary").otherwise("body").alias("role"),
        F.when(v % 17 == 0, "m1").otherwise("m0").alias("model"),
        F.col("embedding").alias("vector"),
        F.col("label").cast("long").alias("collection_id"),
    )


VECTORS = """vectors AS (
  SELECT CAST(floor(vec_id / 3) AS BIGINT) AS item_id, CAST(vec_id % 3 AS INTEGER) AS chunk,
    CASE WHEN vec_id % 3 = 0 THEN 'summary' ELSE 'body' END AS role,
    CASE WHEN vec_id % 17 = 0 THEN 'm1' ELSE 'm0' END AS model, embedding AS vector, CAST(label AS BIGINT) AS collection_id
  FROM embeddings)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_id, target_id, type, confidence``: one link a document, symmetric types ordered, no self-links."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = docs.agg(F.count("*").alias("n"))
    kinds = ("related_to", "same_project", "alternative_to", "contradicts", "duplicate_of", "inspired_by", "references", "continuation_of", "created_from", "belongs_to")
    a, b = F.col("doc_id"), (F.col("doc_id") * 7 + 3) % F.col("n")
    swap = (F.col("k") < 5) & (a > b)
    return (
        docs.crossJoin(F.broadcast(n))  # one row
        .withColumn("k", a % 10)
        .filter(a != b)
        .select(F.when(swap, b).otherwise(a).alias("source_id"), F.when(swap, a).otherwise(b).alias("target_id"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("k") + 1).cast("int")).alias("type"), (a % 100 / 100.0).alias("confidence"))
    )


EDGES = """edges AS (
  SELECT CASE WHEN k < 5 AND a > b THEN b ELSE a END AS source_id, CASE WHEN k < 5 AND a > b THEN a ELSE b END AS target_id,
    (['related_to','same_project','alternative_to','contradicts','duplicate_of','inspired_by','references','continuation_of','created_from','belongs_to'])[CAST(k AS INTEGER) + 1] AS type,
    (a % 100) / 100.0 AS confidence
  FROM (SELECT doc_id AS a, (doc_id * 7 + 3) % (SELECT count(*) FROM documents) AS b, doc_id % 10 AS k FROM documents) WHERE a <> b)"""


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, item_id, stage, outcome, at_us`` from the event log."""
    return as_stage_events(table(spark, sf_dir, "events"))


def as_stage_events(events: DataFrame) -> DataFrame:
    stage = F.when(F.col("event_type") == "signup", "extract").when(F.col("event_type") == "view", "embed").when(F.col("event_type") == "click", "understand").when(F.col("event_type") == "purchase", "relate").otherwise("index")
    outcome = F.when(F.col("value") < 20, "failed").when(F.col("value") < 60, "partial").otherwise("ok")
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("item_id"), stage.alias("stage"), outcome.alias("outcome"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


STAGE_EVENTS = """stage_events AS (
  SELECT event_id AS seq, user_id AS item_id,
    CASE event_type WHEN 'signup' THEN 'extract' WHEN 'view' THEN 'embed' WHEN 'click' THEN 'understand' WHEN 'purchase' THEN 'relate' ELSE 'index' END AS stage,
    CASE WHEN value < 20 THEN 'failed' WHEN value < 60 THEN 'partial' ELSE 'ok' END AS outcome, epoch_us(ts) AS at_us
  FROM events)"""

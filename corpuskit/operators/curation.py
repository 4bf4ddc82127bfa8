"""Rule-checked changes: edges, memberships and collections; upserts; the log and its undoing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Edge types that have no direction.
SYMMETRIC = ("related_to", "same_project", "alternative_to", "contradicts", "duplicate_of")


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows of ``source`` in place of those with the same keys. Keys of ``source`` must be unique."""
    return target.join(source.select(*keys), keys, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def replace_partition(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """``target`` with all rows of each ``key`` in ``source`` replaced by those of ``source``."""
    return target.join(source.select(key).distinct(), key, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def set_deleted(items: DataFrame, ids: DataFrame, deleted: bool = True) -> DataFrame:
    named = ids.select("id").distinct().withColumn("hit", F.lit(True))
    return items.join(named, "id", "left").withColumn("deleted", F.when(F.col("hit"), F.lit(deleted)).otherwise(F.col("deleted"))).select(*items.columns)


def purge(items: DataFrame, edges: DataFrame, vectors: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, edges and vectors without the given items and their children of one level."""
    asked = ids.select("id").distinct()
    children = items.join(asked.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select("id")
    gone = asked.unionByName(children).distinct()
    kept_edges = edges.join(gone, edges["source_id"] == gone["id"], "left_anti").join(gone, F.col("target_id") == gone["id"], "left_anti")
    return items.join(gone, "id", "left_anti").select(*items.columns), kept_edges, vectors.join(gone.withColumnRenamed("id", "item_id"), "item_id", "left_anti").select(*vectors.columns)


def add_edges(edges: DataFrame, proposals: DataFrame, items: DataFrame, suppressions: DataFrame) -> DataFrame:
    """``proposal_id, source_id, target_id, type, reason`` (null: accepted) for ``proposal_id, source_id, target_id, type``.

    Symmetric types are ordered; links to itself, dead ends, edges that exist, suppressed pairs and later repeats of
    one edge are refused."""
    swap = F.col("type").isin(*SYMMETRIC) & (F.col("source_id") > F.col("target_id"))
    p = proposals.select("proposal_id", F.when(swap, F.col("target_id")).otherwise(F.col("source_id")).alias("source_id"), F.when(swap, F.col("source_id")).otherwise(F.col("target_id")).alias("target_id"), "type")
    live = items.filter("NOT deleted").select("id")
    p = p.join(live.select(F.col("id").alias("source_id"), F.lit(True).alias("s_live")), "source_id", "left").join(live.select(F.col("id").alias("target_id"), F.lit(True).alias("t_live")), "target_id", "left")
    p = p.join(edges.select("source_id", "target_id", "type").distinct().withColumn("there", F.lit(True)), ["source_id", "target_id", "type"], "left")
    p = p.withColumns({"a": F.least("source_id", "target_id"), "b": F.greatest("source_id", "target_id")}).join(suppressions.select("a", "b").distinct().withColumn("off", F.lit(True)), ["a", "b"], "left")
    nth = F.row_number().over(Window.partitionBy("source_id", "target_id", "type").orderBy("proposal_id"))
    reason = F.when(F.col("source_id") == F.col("target_id"), "self").when(F.col("s_live").isNull() | F.col("t_live").isNull(), "missing").when(F.col("there"), "exists").when(F.col("off"), "suppressed").when(nth > 1, "repeated")
    return p.withColumn("reason", reason).select("proposal_id", "source_id", "target_id", "type", "reason")


def validate_members(plan: DataFrame, members: DataFrame, items: DataFrame, suppressed: DataFrame, least: float = 0.7) -> DataFrame:
    """``collection_id, item_id, reason`` (null: accepted) for ``collection_id, item_id, confidence``."""
    known = members.select("collection_id").distinct().withColumn("c", F.lit(True))
    live = items.filter("NOT deleted").select(F.col("id").alias("item_id"), F.lit(True).alias("i"))
    p = plan.join(known, "collection_id", "left").join(live, "item_id", "left")
    p = p.join(members.select("collection_id", "item_id").distinct().withColumn("m", F.lit(True)), ["collection_id", "item_id"], "left")
    p = p.join(suppressed.select("collection_id", "item_id").distinct().withColumn("s", F.lit(True)), ["collection_id", "item_id"], "left")
    reason = F.when(F.col("c").isNull() | F.col("i").isNull(), "missing").when(F.round("confidence", 2) < least, "confidence").when(F.col("m"), "exists").when(F.col("s"), "suppressed")
    return p.withColumn("reason", reason).select("collection_id", "item_id", "reason")


def audit_view(audit: DataFrame, entity: int | None = None, latest: int = 50, run: int | None = None) -> DataFrame:
    """The newest ``latest`` entries, of one entity or one run (``run_id``) if given."""
    rows = audit if entity is None else audit.filter(F.col("entity_id") == entity)
    rows = rows if run is None else rows.filter(F.col("run_id") == run)
    return rows.orderBy(F.desc("at_us"), F.desc("seq")).limit(latest)


def fold_audit(audit: DataFrame) -> DataFrame:
    """``entity_id, field, value``: the state that the entries not undone lead to, the last of each field."""
    last = audit.filter("NOT undone").groupBy("entity_id", "field").agg(F.max(F.struct("at_us", "seq", "value")).alias("e"))
    return last.select("entity_id", "field", "e.value")


def undo(audit: DataFrame, ids: DataFrame) -> DataFrame:
    """``seq, entity_id, field, value, conflict``: what undoing the entries ``ids`` (seq) sets each field to, and
    whether a later entry, not undone as well, has changed it since."""
    w = Window.partitionBy("entity_id", "field").orderBy("at_us", "seq")
    live = audit.filter("NOT undone").join(ids.select("seq").distinct().withColumn("asked", F.lit(True)), "seq", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    before = F.last(F.when(~F.col("asked"), F.struct("value")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    later = F.max(F.when(~F.col("asked"), 1).otherwise(0)).over(w.rowsBetween(1, Window.unboundedFollowing))
    return live.withColumns({"before": before, "later": later}).filter("asked").select("seq", "entity_id", "field", F.col("before")["value"].alias("value"), (F.coalesce("later", F.lit(0)) == 1).alias("conflict"))

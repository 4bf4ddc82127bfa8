"""Listings, summaries, cards and slices of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Display groups by type.
DISPLAY_GROUPS = {"url": "links", "pdf": "documents", "text": "documents", "markdown": "documents", "image": "media", "note": "notes"}


def list_items(items: DataFrame, view: str = "library", types: list[str] | None = None, sort: str = "captured", limit: int = 500, offset: int = 0, members: DataFrame | None = None) -> DataFrame:
    """One page of a view: library, links, files, trash or collection (then of ``members``, item_id)."""
    of_view = {
        "library": (~F.col("deleted")) & F.col("parent_id").isNull(),
        "links": (~F.col("deleted")) & (F.col("type") == "url"),
        "files": (~F.col("deleted")) & (~F.col("type").isin("url", "note")),
        "trash": F.col("deleted"),
        "collection": ~F.col("deleted"),
    }
    rows = items.filter(of_view[view])
    if view == "collection":
        rows = rows.join(members.select(F.col("item_id").alias("id")).distinct(), "id", "left_semi")
    if types:
        rows = rows.filter(F.col("type").isin(types))
    order = {"captured": [F.desc("captured_s")], "title": [F.lower("title"), F.desc("captured_s")]}[sort]
    return rows.orderBy(*order, "id").offset(max(0, offset)).limit(max(1, min(5000, limit)))


def children(items: DataFrame, parents: DataFrame) -> DataFrame:
    """Live items below the given ``id``s, in order of capture within each."""
    return items.filter("NOT deleted").join(parents.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi")


def siblings(items: DataFrame, batches: DataFrame) -> DataFrame:
    """Live items of the given batches, in order of capture."""
    return items.filter("NOT deleted").join(batches.select("batch_id").distinct(), "batch_id", "left_semi")


def summaries(items: DataFrame, children: int = 4) -> DataFrame:
    """``id, title, n_children, first_children``: live top-level items with their live children, earliest first."""
    live = items.filter("NOT deleted")
    w = Window.partitionBy("parent_id").orderBy("captured_s", "title", "id")
    kids = live.filter("parent_id IS NOT NULL").withColumn("pos", F.row_number().over(w))
    of = kids.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children"), F.array_sort(F.collect_list(F.when(F.col("pos") <= children, F.struct("pos", F.col("id").alias("child"))))).alias("first"))
    return live.filter("parent_id IS NULL").select("id", "title").join(of, "id", "left").select("id", "title", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.transform("first", lambda x: x["child"]).alias("first_children"))


def cards(items: DataFrame, thin: bool = False) -> DataFrame:
    """``id, type, kind, title, excerpt, chars``: what a reader sees of an item."""
    n = 140 if thin else 400
    flat = F.trim(F.regexp_replace(F.coalesce("extracted_text", F.lit("")), r"[ \t\r\n]+", " "))
    cut = F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…")))
    return items.filter("NOT deleted").select("id", "type", "kind", "title", cut.alias("excerpt"), F.length(F.coalesce("extracted_text", F.lit(""))).alias("chars"))


def budget_cards(cards: DataFrame, budget: int, request: str = "request_id", pos: str = "pos", chars: str = "chars") -> DataFrame:
    """The cards of each request, in order, while their tokens (four characters each) fit; the first stays always."""
    w = Window.partitionBy(request).orderBy(pos)
    cost = F.ceil(F.col(chars) / 4)
    run = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return cards.withColumn("used", run).withColumn("nth", F.row_number().over(w)).filter((F.col("used") <= budget) | (F.col("nth") == 1)).drop("nth")


def read_slices(items: DataFrame, requests: DataFrame) -> DataFrame:
    """``request_id, id, slice, total, has_more`` for ``request_id, id, offset, size``."""
    text = F.coalesce("extracted_text", F.lit(""))
    return requests.join(items.filter("NOT deleted").select("id", text.alias("t")), "id").select("request_id", "id", F.expr("substring(t, offset + 1, size)").alias("slice"), F.length("t").alias("total"), (F.col("offset") + F.col("size") < F.length("t")).alias("has_more"))


def recent_items(items: DataFrame, since_s: int, types: list[str] | None, limit: int) -> DataFrame:
    """The newest live items since a time. The filters come before the limit."""
    rows = items.filter((~F.col("deleted")) & (F.col("captured_s") >= since_s))
    if types:
        rows = rows.filter(F.col("type").isin(types))
    return rows.orderBy(F.desc("captured_s"), "id").limit(limit)


def cue_leg(items: DataFrame, cues: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, id, pos``: the newest live top-level items of a cued type, subtype (where
    items have one) or kind. cues: ``query_id, field, value``.

    Only the newest ``k`` of each type, subtype and kind can be asked for, so these are ranked first."""
    live = items.filter("NOT deleted AND parent_id IS NULL")
    asked_by = [c for c in ("type", "subtype", "kind") if c in items.columns]
    named = live.select("id", "captured_s", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in asked_by])).alias("v")).select("id", "captured_s", "v.field", "v.value")
    newest = F.row_number().over(Window.partitionBy("field", "value").orderBy(F.desc("captured_s"), "id"))
    few = named.withColumn("r", newest).filter(F.col("r") <= k).drop("r")
    hits = cues.join(few, ["field", "value"]).select("query_id", "id", "captured_s").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("captured_s"), "id"))
    return hits.withColumn("pos", place).filter(F.col("pos") <= k).select("query_id", "id", "pos")


def group_hits(hits: DataFrame, items: DataFrame) -> DataFrame:
    """``query_id, id, group, group_no, pos``: hits in display groups, groups in order of their best hit."""
    table = F.create_map(*[F.lit(x) for kv in DISPLAY_GROUPS.items() for x in kv])
    named = hits.join(items.select("id", "type"), "id").withColumn("group", F.coalesce(F.try_element_at(table, F.col("type")), F.lit("other")))
    best = F.min("pos").over(Window.partitionBy("query_id", "group"))
    return named.withColumn("best", best).withColumn("group_no", F.dense_rank().over(Window.partitionBy("query_id").orderBy("best"))).select("query_id", "id", "group", "group_no", "pos")


def readable_text(extracted: Column, *others: Column) -> Column:
    """The text, else what else there is, parted by blank lines."""
    return F.when(F.length(F.trim(extracted)) > 0, extracted).otherwise(F.concat_ws("\n\n", *others))

"""Undoing entries of the audit log, whole runs too: an inverse for each action, folded newest first.

An entry touches a pair of items (links), an item (its fields, the bin) or a collection (its name and members). Entries
of different pairs and items don't meet, so each is folded by itself. Collections meet where one takes a name that
another has or had: they are labelled by the least id that they are joined to over the names of the entries undone, and
folded label by label."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.sources.tables import written

#: What entries record, and what they are folded by.
LINKS, ITEMS, COLLECTIONS = ("create_link", "remove_link"), ("update_item", "create_note", "trash", "restore", "kept_again"), ("create_collection", "rename_collection", "delete_collection", "add_member", "remove_member")
LOG = "seq long, run_id long, actor string, action string, collection_id long, item_id long, other_id long, name string, before string, field string, ids array<long>, undone boolean"
OUT = "kind string, a long, b long, text string, value string, present boolean, seq long"


def of_runs(log: DataFrame, runs: DataFrame) -> DataFrame:
    """``seq`` of what ``runs`` (run_id) did and is not undone."""
    return log.filter("NOT undone").join(runs.select("run_id").distinct(), "run_id", "left_semi").select("seq")


def undo_entries(log: DataFrame, asked: DataFrame, collections: DataFrame, members: DataFrame, items: DataFrame, links: DataFrame) -> DataFrame:
    """What undoing the entries ``asked`` (seq), newest first, leaves: ``kind, a, b, text, value, present, seq``.

    log: ``LOG``; ``name`` is the name after, or the link's type, ``before`` the name or value before, ``ids`` the members
    of a collection that was deleted, or the items that went to the bin. collections: ``collection_id, name``; members:
    ``collection_id, item_id``; items: ``id``; links: ``source_id, target_id, type``. Rows by kind:

    ``entry``: of each entry asked for, by ``seq``, ``value`` null if it is undone, else why not: ``undone`` already,
    ``clash`` (its name belongs to another collection), ``gone`` (its item or collection is), ``nothing`` to undo.
    ``collection`` a: there under the name ``value``, or not. ``member`` a of collection, b of item; ``link`` a, b by
    type ``text``; ``item`` a: field ``text`` is ``value``; ``bin`` a: ``present`` there. ``suppression`` of what an agent
    did (``text``: link, member or name; the latter with ``value``), on or off. Only what the undoing wrote is given."""
    wanted = log.join(asked.select("seq").distinct(), "seq", "left_semi")
    there = items.select(F.col("id").alias("item_id"), F.lit(True).alias("item_there")).distinct()
    w = wanted.join(there, "item_id", "left").join(there.select(F.col("item_id").alias("other_id"), F.col("item_there").alias("other_there")), "other_id", "left")
    w = written(w.fillna(False, ["item_there", "other_there"]), "asked")
    pairs = w.filter(F.col("action").isin(*LINKS)).withColumns({"a": F.least("item_id", "other_id"), "b": F.greatest("item_id", "other_id")})
    had = links.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), F.col("type").alias("name")).distinct().withColumn("has", F.lit(True))
    linked = pairs.join(had, ["a", "b", "name"], "left").groupBy("a", "b").applyInPandas(_links, OUT)
    alone = w.filter(F.col("action").isin(*ITEMS)).groupBy("item_id").applyInPandas(_items, OUT)
    other = w.filter(~F.col("action").isin(*LINKS, *ITEMS, *COLLECTIONS)).select(*_entry(F.when(F.col("undone"), "undone").otherwise("nothing")))
    moved = w.filter(F.col("action").isin(*COLLECTIONS))
    labels = written(_labels(moved, collections), "labels")
    state = labels.join(collections.select("collection_id", "name"), "collection_id", "left").filter("name IS NOT NULL").select("label", F.lit("collection").alias("row"), "collection_id", F.lit(None).cast("long").alias("item_id"), "name")
    # All members of collections that go, and of the others those that entries name.
    made = moved.filter("action = 'create_collection'").select("collection_id").distinct()
    named = moved.filter("item_id IS NOT NULL").select("collection_id", "item_id").distinct()
    listed = moved.filter("action = 'delete_collection'").select("collection_id", F.explode("ids").alias("item_id"))
    some = members.join(made, "collection_id", "left_semi").unionByName(members.join(named.unionByName(listed), ["collection_id", "item_id"], "left_semi")).distinct()
    some = some.join(labels, "collection_id").select("label", F.lit("member").alias("row"), "collection_id", "item_id", F.lit(None).cast("string").alias("name"))
    known = listed.select("item_id").distinct().join(there, "item_id", "left_semi")
    listed = listed.join(known, "item_id", "left_semi").join(labels, "collection_id").select("label", F.lit("known").alias("row"), "collection_id", "item_id", F.lit(None).cast("string").alias("name"))
    state = state.unionByName(some).unionByName(listed)
    entries = moved.join(labels, "collection_id").select(*moved.columns, (F.col("label") + 0).alias("label"))
    folded = entries.groupBy("label").cogroup(state.groupBy("label")).applyInPandas(_collections, OUT)
    return reduce(DataFrame.unionByName, [linked, alone, other, folded])


def _entry(value) -> list:
    none = lambda kind: F.lit(None).cast(kind)
    return [F.lit("entry").alias("kind"), none("long").alias("a"), none("long").alias("b"), none("string").alias("text"), value.alias("value"), none("boolean").alias("present"), F.col("seq")]


def _labels(moved: DataFrame, collections: DataFrame) -> DataFrame:
    """``collection_id, label``: the least collection that one is joined to over names of the entries and of now."""
    key = lambda c: F.lower(F.trim(c))
    told = moved.select("collection_id", F.explode(F.array(key(F.col("name")), key(F.col("before")))).alias("key")).filter("key IS NOT NULL").distinct()
    holders = collections.select("collection_id", key(F.col("name")).alias("key")).join(told.select("key").distinct(), "key", "left_semi")
    own = moved.select("collection_id", F.concat(F.lit("\u0000"), F.col("collection_id").cast("string")).alias("key")).distinct()
    edges = written(told.unionByName(holders.select("collection_id", "key")).unionByName(own).distinct().withColumn("label", F.col("collection_id")), "names")
    while True:
        by_key = edges.groupBy("key").agg(F.min("label").alias("least"))
        by_id = edges.join(by_key, "key").groupBy("collection_id").agg(F.min("least").alias("least"))
        after = written(edges.join(by_id, "collection_id").select("collection_id", "key", "least", (F.col("least") < F.col("label")).alias("moved")), "names")
        if after.filter("moved").isEmpty():
            return after.select("collection_id", F.col("least").alias("label")).distinct()
        edges = after.select("collection_id", "key", F.col("least").alias("label"))


class _Out:
    """The last write of each cell, and what became of each entry."""

    def __init__(self):
        self.cells: dict[tuple, tuple] = {}
        self.entries: list[tuple] = []

    def put(self, kind, a=None, b=None, text=None, value=None, present=None, off_key=()):
        self.cells[(kind, a, b, text, *off_key)] = (kind, a, b, text, value, present, None)

    def suppress(self, on, text, a, b=None, value=None):
        self.put("suppression", a, b, text, value, on, (value,))

    def frame(self) -> pd.DataFrame:
        rows = [*self.cells.values(), *(("entry", None, None, None, why, None, seq) for seq, why in self.entries)]
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in OUT.split(", ")], dtype=object)
        return out.where(out.notna(), None)


def _newest_first(group: pd.DataFrame):
    """The entries of a group not undone yet, and an output that has the others."""
    out = _Out()
    rows = group.sort_values("seq", ascending=False).drop_duplicates("seq").to_dict("records")
    out.entries = [(int(r["seq"]), "undone") for r in rows if r["undone"]]
    return out, [r for r in rows if not r["undone"]]


def _links(group: pd.DataFrame) -> pd.DataFrame:
    a, b = int(group["a"].iloc[0]), int(group["b"].iloc[0])
    out, rows = _newest_first(group)
    for r in rows:
        why = None
        if r["action"] == "create_link":
            out.put("link", a, b, r["name"], present=False)
            if r["actor"] == "agent":
                out.suppress(True, "link", a, b)
        elif not (r["item_there"] and r["other_there"]):
            why = "gone"
        else:
            out.put("link", a, b, r["name"], present=True)
            out.suppress(False, "link", a, b)
        out.entries.append((int(r["seq"]), why))
    return out.frame()


def _items(group: pd.DataFrame) -> pd.DataFrame:
    item = group["item_id"].iloc[0]
    item = None if pd.isna(item) else int(item)
    out, rows = _newest_first(group)
    for r in rows:
        why, action = None, r["action"]
        others = [int(i) for i in r["ids"]] if r["ids"] is not None and len(r["ids"]) else [item]
        if action == "kept_again":
            why = "nothing"
        elif action in ("trash", "restore"):
            for i in others:
                out.put("bin", i, present=action == "restore")
        elif not r["item_there"]:
            why = "gone"
        elif action == "create_note":
            out.put("bin", item, present=True)
        else:
            out.put("item", item, text=r["field"], value=r["before"])
        out.entries.append((int(r["seq"]), why))
    return out.frame()


def _collections(group: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    key = lambda name: name.strip().lower()
    names = {int(c): n for row, c, n in zip(state["row"], state["collection_id"], state["name"], strict=True) if row == "collection"}
    pairs = lambda what: {(int(c), int(i)) for row, c, i in zip(state["row"], state["collection_id"], state["item_id"], strict=True) if row == what}
    members, known = pairs("member"), pairs("known")
    out, rows = _newest_first(group)

    def member(c, i, on):
        (members.add if on else members.discard)((c, i))
        out.put("member", c, i, present=on)

    for r in rows:
        why, action, c = None, r["action"], int(r["collection_id"])
        item = None if pd.isna(r["item_id"]) else int(r["item_id"])
        clash = r["before"] is not None and any(key(n) == key(r["before"]) for o, n in names.items() if action == "delete_collection" or o != c)
        if action == "create_collection":
            name = names.pop(c, r["name"])
            for _, i in sorted(m for m in members if m[0] == c):
                member(c, i, False)
                if r["actor"] == "agent":
                    out.suppress(True, "name", None, i, key(name))
            out.put("collection", c, present=False)
        elif action in ("rename_collection", "delete_collection"):
            if clash:
                why = "clash"
            elif action == "rename_collection" and c not in names:
                why = "gone"
            else:
                names[c] = r["before"]
                out.put("collection", c, value=r["before"], present=True)
                for i in sorted(int(i) for i in (r["ids"] if action == "delete_collection" and r["ids"] is not None else ())):
                    if (c, i) in known:
                        member(c, i, True)
        elif action == "add_member":
            member(c, item, False)
            if r["actor"] == "agent":
                out.suppress(True, "member", c, item)
                if c in names:
                    out.suppress(True, "name", None, item, key(names[c]))
        elif c not in names or not r["item_there"]:
            why = "gone"
        else:
            member(c, item, True)
            out.suppress(False, "member", c, item)
            out.suppress(False, "name", None, item, key(names[c]))
        out.entries.append((int(r["seq"]), why))
    return out.frame()

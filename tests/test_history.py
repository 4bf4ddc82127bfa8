"""Undoing by folds of links, items and labelled collections, against undoing entry by entry over one state."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import history


class Library:
    """One state, changed and undone entry by entry."""

    def __init__(self, rng):
        self.rng, self.names, self.members, self.links, self.fields, self.bin, self.items = rng, {c: f"Name {c}" for c in range(6)}, {(c, i) for c in range(6) for i in range(8) if (c + i) % 3 == 0}, {(i, i + 1, "related_to") for i in range(6)}, {(i, f): f"{f}{i}" for i in range(8) for f in "xy"}, {7}, set(range(8))
        self.log, self.off = [], {}

    def copy(self):
        return dict(self.names), set(self.members), set(self.links), dict(self.fields), set(self.bin)

    def entry(self, action, **kw):
        row = dict(seq=len(self.log), run_id=self.rng.randrange(3), actor=self.rng.choice(["agent", "user"]), action=action, collection_id=None, item_id=None, other_id=None, name=None, before=None, field=None, ids=None, undone=False) | kw
        self.log.append(row)

    def act(self):
        rng, i, j = self.rng, self.rng.randrange(8), self.rng.randrange(8)
        c = rng.choice(sorted(self.names))
        free = [n for n in (f"Name {k}" for k in range(14)) if n not in self.names.values()]
        what = rng.randrange(9)
        if what == 0 and len(self.names) < 10:
            new = max([*self.names, *(r["collection_id"] or 0 for r in self.log)]) + 1
            self.names[new] = rng.choice(free)
            self.entry("create_collection", collection_id=new, name=self.names[new])
        elif what == 1 and len(self.names) > 3:
            ids = sorted(m[1] for m in self.members if m[0] == c)
            self.entry("delete_collection", collection_id=c, before=self.names.pop(c), ids=ids)
            self.members -= {(c, k) for k in ids}
        elif what == 2:
            old, self.names[c] = self.names[c], rng.choice(free)
            self.entry("rename_collection", collection_id=c, before=old, name=self.names[c])
        elif what == 3 and (c, i) not in self.members:
            self.members.add((c, i))
            self.entry("add_member", collection_id=c, item_id=i)
        elif what == 4 and (c, i) in self.members:
            self.members.discard((c, i))
            self.entry("remove_member", collection_id=c, item_id=i)
        elif what == 5 and i < j and (i, j, "related_to") not in self.links:
            self.links.add((i, j, "related_to"))
            self.entry("create_link", item_id=j, other_id=i, name="related_to")
        elif what == 6 and self.links:
            link = rng.choice(sorted(self.links))
            self.links.discard(link)
            self.entry("remove_link", item_id=link[0], other_id=link[1], name=link[2])
        elif what == 7:
            f = rng.choice("xy")
            self.entry("update_item", item_id=i, field=f, before=self.fields[i, f])
            self.fields[i, f] = f"new {len(self.log)}"
        elif what == 8:
            self.entry("restore" if i in self.bin else "trash", item_id=i, ids=[i])
            self.bin ^= {i}

    def undo(self, r):
        c, i, j, agent, key = r["collection_id"], r["item_id"], r["other_id"], r["actor"] == "agent", lambda n: n.strip().lower()
        if r["undone"]:
            return "undone"
        a = r["action"]
        if a == "create_collection":
            name = self.names.pop(c, r["name"])
            for m in [m for m in self.members if m[0] == c]:
                self.members.discard(m)
                if agent:
                    self.off["name", None, m[1], key(name)] = True
        elif a in ("rename_collection", "delete_collection"):
            if any(key(n) == key(r["before"]) for o, n in self.names.items() if o != c or a == "delete_collection"):
                return "clash"
            if a == "rename_collection" and c not in self.names:
                return "gone"
            self.names[c] = r["before"]
            self.members |= {(c, k) for k in (r["ids"] or ()) if k in self.items}
        elif a == "add_member":
            self.members.discard((c, i))
            if agent:
                self.off["member", c, i, None] = True
                if c in self.names:
                    self.off["name", None, i, key(self.names[c])] = True
        elif a == "remove_member":
            if c not in self.names or i not in self.items:
                return "gone"
            self.members.add((c, i))
            self.off["member", c, i, None] = self.off["name", None, i, key(self.names[c])] = False
        elif a == "create_link":
            self.links.discard((min(i, j), max(i, j), r["name"]))
            if agent:
                self.off["link", min(i, j), max(i, j), None] = True
        elif a == "remove_link":
            if not {i, j} <= self.items:
                return "gone"
            self.links.add((min(i, j), max(i, j), r["name"]))
            self.off["link", min(i, j), max(i, j), None] = False
        elif a == "update_item":
            if i not in self.items:
                return "gone"
            self.fields[i, r["field"]] = r["before"]
        elif a in ("trash", "restore"):
            self.bin = self.bin - {i} if a == "trash" else self.bin | {i}
        else:
            return "nothing"
        return None


@pytest.mark.parametrize(("seed", "share", "lost"), [(1, 1.0, ()), (2, 0.5, ()), (3, 0.4, (2, 5)), (4, 0.6, (1,))])
def test_undo(spark, seed, share, lost):
    rng = random.Random(seed)
    lib = Library(rng)
    start = lib.copy()
    for _ in range(260):
        lib.act()
    lib.entry("kept_again", item_id=3)
    lib.entry("make_tea")
    for r in lib.log:
        r["undone"] = share < 1 and rng.random() < 0.1
    lib.items -= set(lost)
    asked = [r["seq"] for r in lib.log if rng.random() < share]
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    log = spark.createDataFrame([tuple(r[f.split()[0]] for f in history.LOG.split(", ")) for r in lib.log], history.LOG)
    collections, members, items, links = frame(lib.names.items(), "collection_id long, name string"), frame(lib.members, "collection_id long, item_id long"), frame([(i,) for i in lib.items], "id long"), frame(lib.links, "source_id long, target_id long, type string")
    names, held, joined, fields, away = lib.copy()
    got = history.undo_entries(log, spark.createDataFrame([(s,) for s in asked], "seq long"), collections, members, items, links).collect()
    off = {}
    for r in got:
        if r.kind == "collection":
            names.update({r.a: r.value}) if r.present else names.pop(r.a, None)
        elif r.kind == "member":
            (held.add if r.present else held.discard)((r.a, r.b))
        elif r.kind == "link":
            (joined.add if r.present else joined.discard)((r.a, r.b, r.text))
        elif r.kind == "item":
            fields[r.a, r.text] = r.value
        elif r.kind == "bin":
            (away.add if r.present else away.discard)(r.a)
        elif r.kind == "suppression":
            assert (r.text, r.a, r.b, r.value) not in off
            off[r.text, r.a, r.b, r.value] = r.present
    outcome = {s: lib.undo(lib.log[s]) for s in sorted(asked, reverse=True)}
    assert {r.seq: r.value for r in got if r.kind == "entry"} == outcome
    assert (names, held, joined, fields, away) == lib.copy() and off == lib.off
    if share == 1.0:
        assert lib.copy() == start and set(outcome.values()) == {None, "nothing"}
    else:
        assert {"undone", "clash"} <= set(outcome.values()) and ("gone" in outcome.values()) >= bool(lost)


def test_runs_and_nothing(spark):
    log = spark.createDataFrame([(1, 5, "agent", "create_link", None, 1, 2, "x", None, None, None, False), (2, 5, "agent", "create_link", None, 1, 2, "x", None, None, None, True), (3, 6, "agent", "create_link", None, 1, 2, "x", None, None, None, False)], history.LOG)
    assert [r.seq for r in history.of_runs(log, spark.createDataFrame([(5,)], "run_id long")).collect()] == [1]
    empty = lambda schema: spark.createDataFrame([], schema)
    out = history.undo_entries(log, empty("seq long"), empty("collection_id long, name string"), empty("collection_id long, item_id long"), empty("id long"), empty("source_id long, target_id long, type string"))
    assert out.filter(F.lit(True)).count() == 0

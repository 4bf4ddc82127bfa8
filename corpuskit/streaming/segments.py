"""Tables that micro-batches change: immutable segments, newest first, merged tier by tier.

A batch writes one segment: the new rows of each of its keys, and its keys themselves, so that older rows of them are
dead (a key without rows is a tombstone). ``fanout`` segments of a tier are merged into one of the next, which drops
the rows that died among them; so a batch writes its own changes and, over time, each row once a tier. What a version
of the table consists of stands in a list that is written last: a batch that is repeated, or dies half-way, leaves the
version before it as it was. Folders that neither of the last two versions names are removed."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.sources.tables import children, delete

FANOUT = 4


@dataclass(frozen=True)
class Segment:
    name: str
    tier: int
    last: int  # the newest batch in it


class Segments:
    """The segments at ``path``; ``keys`` are the columns that tell what a row replaces."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], fanout: int = FANOUT):
        self.spark, self.path, self.keys, self.fanout = spark, path.rstrip("/"), keys, fanout

    def version(self, before: int | None = None) -> tuple[int, list[Segment]]:
        """The newest version (older than ``before``), and its segments, oldest first; -1 and none at the beginning."""
        known = sorted(int(v) for v in self._named("versions") if before is None or int(v) < before)
        for v in reversed(known):
            rows = self.spark.read.schema("name string, tier int, last long").json(f"{self.path}/versions/{v:09d}").collect()  # a few a tier
            if rows:
                return v, sorted((Segment(*r) for r in rows), key=lambda s: s.last)
        return -1, []

    def _named(self, folder: str) -> list[str]:
        return [n for n in children(self.spark, f"{self.path}/{folder}") if not n.startswith((".", "_"))]

    def write(self, batch_id: int, tables: dict[str, DataFrame], changed: DataFrame) -> None:
        """Adds the version ``batch_id``: the rows of ``tables`` replace all rows of the keys ``changed``."""
        _, segments = self.version(batch_id)
        segments = [*segments, self._store(f"b{batch_id:09d}-t0", 0, batch_id, tables, changed.select(*self.keys).distinct())]
        while (tier := next((t for t in {s.tier for s in segments} if sum(s.tier == t for s in segments) >= self.fanout), None)) is not None:
            some = [s for s in segments if s.tier == tier]
            oldest = segments[0] in some
            gone = self._keys(some)
            rows = {name: self._live(name, some) for name in tables}
            left = gone if not oldest else reduce(DataFrame.unionByName, [rows[n].select(*self.keys) for n in tables]).distinct()
            merged = self._store(f"b{batch_id:09d}-t{tier + 1}", tier + 1, some[-1].last, rows, left.select(*self.keys))
            segments = sorted([s for s in segments if s not in some] + [merged], key=lambda s: s.last)
        listed = self.spark.createDataFrame([(s.name, s.tier, s.last) for s in segments], "name string, tier int, last long")
        listed.coalesce(1).write.mode("overwrite").json(f"{self.path}/versions/{batch_id:09d}")
        self._sweep(batch_id)

    def _store(self, name: str, tier: int, last: int, tables: dict[str, DataFrame], keys: DataFrame) -> Segment:
        for table, rows in [*tables.items(), ("_keys", keys)]:
            rows.write.mode("overwrite").parquet(f"{self.path}/segments/{name}/{table.strip('_')}")
        return Segment(name, tier, last)

    def _read(self, table: str, segments: list[Segment]) -> DataFrame:
        read = lambda s: self.spark.read.parquet(f"{self.path}/segments/{s.name}/{table}").withColumn("_last", F.lit(s.last).cast("long"))
        return reduce(DataFrame.unionByName, map(read, segments))

    def _keys(self, segments: list[Segment]) -> DataFrame:
        """Each key with the newest segment that has it."""
        return self._read("keys", segments).groupBy(*self.keys).agg(F.max("_last").alias("_newest"))

    def _live(self, table: str, segments: list[Segment]) -> DataFrame:
        rows = self._read(table, segments)
        if len(segments) > 1:
            newest = self._keys(segments).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], "_newest")
            same: Column = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)])
            rows = rows.join(newest, same & (F.col("_last") == F.col("_newest")), "left_semi")
        return rows.drop("_last")

    def read(self, table: str) -> DataFrame:
        """The rows of the newest version."""
        version, segments = self.version()
        if version < 0:
            raise ValueError(f"nothing has been written to {self.path}")
        return self._live(table, segments)

    def _sweep(self, batch_id: int) -> None:
        """Removes the folders and lists of versions before the last two."""
        older, before = self.version(batch_id)
        used = {s.name for s in (*before, *self.version()[1])}
        for name in self._named("segments"):
            if name not in used:
                delete(self.spark, f"{self.path}/segments/{name}")
        for v in self._named("versions"):
            if int(v) < older:
                delete(self.spark, f"{self.path}/versions/{v}")

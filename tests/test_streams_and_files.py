from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import index, lifecycle
from corpuskit.plans import model
from corpuskit.sources import files
from corpuskit.streaming import streams
from corpuskit.streaming.segments import Segments


@pytest.fixture(scope="module")
def events(spark, sf_dir, tmp_path_factory):
    """The event log in three files, to be streamed one a batch."""
    path = str(tmp_path_factory.mktemp("events"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts", "event_id")
    rows.repartitionByRange(3, "ts", "event_id").write.mode("overwrite").parquet(path)
    return path


def run(stream, name, mode, tmp_path):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def read(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_dedupe(spark, events, tmp_path):
    got = run(streams.stream_dedupe(read(spark, events), "user_id", within="3650 days"), "first_by_user", "append", tmp_path)
    assert got.count() == spark.read.parquet(events).select("user_id").distinct().count()


def test_progress_equals_batch(spark, events, tmp_path):
    as_results = lambda df: df.select(F.col("event_type").alias("stage"), F.when(F.col("value") < 20, "failed").otherwise("ok").alias("outcome"))
    got = run(streams.progress_stream(as_results(read(spark, events))), "progress", "complete", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streams.progress_stream(as_results(spark.read.parquet(events))).collect()))


def test_status_stream_equals_fold(spark, sf_dir, tmp_path):
    rows = model.stage_events(spark, sf_dir)
    path = str(tmp_path / "results")
    for i, part in enumerate((rows.filter("at_us % 1 = 0"),)):
        part.repartition(1).write.mode("append").parquet(path)
    got = run(streams.status_stream(read(spark, path)), "statuses", "update", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lifecycle.status_fold(rows).collect()))


def test_within_equals_join(spark, events, tmp_path):
    as_captures = lambda df: df.select("user_id", F.col("event_id").alias("id"), "ts")
    got = run(streams.stream_within(as_captures(read(spark, events)), as_captures(read(spark, events)), 600, "3650 days"), "near", "append", tmp_path)
    a = as_captures(spark.read.parquet(events))
    b = a.toDF("u2", "id2", "ts2")
    want = a.join(b, (F.col("user_id") == F.col("u2")) & (F.col("id") < F.col("id2")) & (F.abs(F.unix_seconds("ts") - F.unix_seconds("ts2")) < 36_000)).count()
    assert abs(got.count() - want) <= 2 and want > 0


def same(got, want):
    columns = sorted(want.columns)
    return sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_index_sink_equals_rebuild(spark, sf_dir, tmp_path):
    """Ten batches: each writes what it changes, merges keep few segments, and the index is that of a rebuild."""
    docs = model.items(spark, sf_dir).filter("id < 60").select("id", F.lit("title").alias("field"), F.col("title").alias("text"))
    path, state = str(tmp_path / "index"), {}
    sink = streams.index_sink(path)
    for n in range(10):
        batch = docs.filter(F.col("id") % 10 == n) if n < 6 else docs.filter(F.col("id") % (n - 4) == 0).withColumn("text", F.when(F.col("id") % 4 == 1, None).otherwise(F.concat("text", F.lit(f" change{n}"))))
        state |= {r.id: r.text for r in batch.collect()}
        sink(batch, n)
        if n in (3, 7):
            sink(batch, n)  # a batch that is done again changes nothing
        newest = spark.read.parquet(f"{path}/segments/b{n:09d}-t0/postings") if any(s.name == f"b{n:09d}-t0" for s in Segments(spark, path, ["id"]).version()[1]) else None
        assert newest is None or {r.id for r in newest.select("id").collect()} <= {r.id for r in batch.collect()}
        want = index.build_index(spark.createDataFrame([(i, "title", t) for i, t in state.items() if t is not None], "id long, field string, text string"))
        got = streams.read_index(spark, path)
        for name in ("postings", "doc_stats", "term_stats"):
            assert same(getattr(got, name), getattr(want, name)), (n, name)
        assert got.totals.collect() == want.totals.collect()
    version, segments = Segments(spark, path, ["id"]).version()
    assert version == 9 and len(segments) <= 6 and max(s.tier for s in segments) == 1
    assert len(os.listdir(f"{path}/segments")) <= 12 and len([v for v in os.listdir(f"{path}/versions") if not v.startswith(".")]) <= 3


def test_segments_keep_tombstones_until_the_oldest(spark, tmp_path):
    store = Segments(spark, str(tmp_path / "s"), ["k"], fanout=2)
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v long")
    keys = lambda *x: spark.createDataFrame([(k,) for k in x], "k string")
    for n, (r, k) in enumerate([(rows(("a", 1), ("b", 1), (None, 0)), keys("a", "b", None)), (rows(("c", 2)), keys("c")), (rows(), keys("a")), (rows(("b", 4), ("b", 5)), keys("b")), (rows(), keys("zz", None)), (rows(("a", 9)), keys("a"))]):
        store.write(n, {"rows": r}, k)
    assert sorted(map(tuple, store.read("rows").collect())) == [("a", 9), ("b", 4), ("b", 5), ("c", 2)]
    with pytest.raises(ValueError, match="nothing"):
        Segments(spark, str(tmp_path / "none"), ["k"]).read("rows")


def test_vector_sink_embeds_changes_only(spark, tmp_path):
    seen = []

    def embed(texts):
        seen.append(sorted(r.id.item_id for r in texts.collect()))
        return texts.select("id", F.array(F.length("text").cast("double")).alias("vector"))

    sink = streams.vector_sink(str(tmp_path / "v"), "m0", embed)
    batch = lambda *x: spark.createDataFrame(list(x), "id string, text string")
    sink(batch(("a", "one text"), ("b", "two"), ("c", "three")), 0)
    sink(batch(("a", "one text"), ("b", "changed"), ("c", None), ("d", "new")), 1)
    assert seen == [["a", "b", "c"], ["b", "d"]]
    got = {r.item_id: r.vector for r in streams.read_vectors(spark, str(tmp_path / "v")).collect()}
    assert got == {"a": [8.0], "b": [7.0], "d": [3.0]}


def run_turns(spark, tmp_path, schema, batches, operator, name):
    """The rows that come out when each batch of rows is a turn of the stream of its own."""
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(path)
        stream = operator(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))
        write = lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"n={n}"))
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).drop("n").collect()


def test_groups_reach_every_branch(spark, tmp_path):
    """String keys; a batch that is whole, one that waits for its gate, one of one item, and late items of each kind."""
    first = [("w", "1", 2, 0), ("w", "1", 2, 1), ("g", "a", 3, 0), ("g", "b", 3, 50), ("s", "x", 1, 5), ("t", "p", 4, 0)]
    second = [("w", "2", 2, 60), ("g", "c", 3, 95), ("t", "q", 4, 80)]
    third = [("w", "3", 2, 5_000), ("clock", "z", 1, 5_000)]
    turns = [[(*r[:3], r[3] + 1_000_000) for r in rows] for rows in (first, second, third)]  # nothing at the epoch, the first watermark
    got = run_turns(spark, tmp_path, "batch_id string, item_id string, size int, ts long", turns, streams.group_complete, "let_go")
    assert sorted(map(tuple, got)) == sorted([("w", 2, "complete"), ("w", 1, "late"), ("g", 2, "gate"), ("g", 1, "late"), ("s", 1, "single"), ("t", 2, "gate"), ("clock", 1, "single")])


def test_repeats_are_forgotten(spark, tmp_path):
    day = 86_400
    batches = [[("c", "k", 50), ("a", "k", 10), ("b", "k", 10)], [("d", "k", 5 * day), ("x", "other", 5 * day)], [("e", "k", 200 * day)], [("f", "k", 201 * day)]]
    got = {r.id: (r.first_id, r.repeated, r.kept_s) for r in run_turns(spark, tmp_path, "id string, key string, ts long", batches, lambda s: streams.mark_repeats(s).withColumn("kept_s", F.unix_seconds("kept_at")), "repeats")}
    # The timer of k is due at day 35; the watermark is at day 170 once e has come, and e came before it.
    assert {k: v[:2] for k, v in got.items()} == {"a": ("a", False), "b": ("a", True), "c": ("a", True), "d": ("a", True), "x": ("x", False), "e": ("a", True), "f": ("a", True)}
    assert got["c"][2] == 50 and got["b"][2] == 10 and got["d"][2] == 5 * day


def test_table_sink(spark, tmp_path):
    sink = streams.table_sink(str(tmp_path / "t"), ["k"])
    sink(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), 0)
    sink(spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), 1)
    assert sorted(map(tuple, streams.read_table(spark, str(tmp_path / "t"), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_files(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.md").write_text("# Title\ntext")
    (tmp_path / "d" / "sub" / "t.csv").write_text("run;tokens;x\n1;2;3\n\n4;5;6\n")
    (tmp_path / "d" / "b.bin").write_bytes(b"\x00\x01\x02")
    got = {r.name: r for r in files.ingest_files(spark, str(tmp_path / "d")).collect()}
    assert got["a.md"].type == "markdown" and got["a.md"].text == "# Title\ntext" and got["a.md"].size == 12
    assert got["b.bin"].type == "unknown" and got["b.bin"].text is None
    p = files.profile_delimited(files.ingest_files(spark, str(tmp_path / "d")).filter("name = 't.csv'")).first()
    assert (p.delimiter, list(p.columns), p.n_rows) == (";", ["run", "tokens", "x"], 2)
    assert p.preview[0] == "run: 1 · tokens: 2 · x: 3"


def test_folder_manifest(spark):
    rows = [("r", "a.py", 1), ("r", "b.py", 2), ("r", "node_modules/x.js", 3), ("r", ".git/y", 4), ("r", "d/e/f/g/h.txt", 5), ("r", "d/z.TXT", 6), ("q", "n", 7)]
    got = {r.root: r for r in files.folder_manifest(spark.createDataFrame(rows, "root string, rel string, size long"), max_files=2).collect()}
    assert (got["r"].n_files, got["r"].truncated, got["r"].extensions) == (2, True, {"py": 2})
    assert (got["q"].n_files, got["q"].bytes, got["q"].truncated) == (1, 7, False)

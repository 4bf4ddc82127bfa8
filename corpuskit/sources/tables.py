"""Tables whose JSON columns may be broken, and tables written for reuse."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.operators import index as index_ops
from corpuskit.operators.index import Index

#: Buckets of terms in a stored index.
BUCKETS = 64
_WRITTEN: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share. One is made only for a local session that names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", at := tempfile.mkdtemp(prefix="corpuskit-"))
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: what follows starts from the files, and its plan from a scan."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def string_list(json: Column) -> Column:
    """The strings of a JSON array; other members are dropped, anything but an array gives none."""
    members = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")
    texts = F.filter(members, lambda x: F.schema_of_variant(x) == "STRING")
    return F.coalesce(F.transform(texts, lambda x: F.variant_get(x, "$", "string")), F.array().cast("array<string>"))


def read_rows(rows: DataFrame, lists: list[str], objects: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with JSON text columns parsed: ``lists`` to arrays of strings, ``objects`` (column: schema) to structs.
    Broken JSON gives an empty list or a struct of nulls, never an error."""
    parsed = {c: string_list(F.col(c)) for c in lists}
    parsed |= {c: F.coalesce(F.from_json(c, schema), F.from_json(F.lit("{}"), schema)) for c, schema in (objects or {}).items()}
    return rows.withColumns(parsed)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """What the files under ``paths`` are: a number that changes with their names, sizes and times. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "modificationTime", "length")
    return f"{files.agg(F.sum(F.xxhash64('path', 'modificationTime', 'length').cast('decimal(38,0)')).alias('n')).first().n}"


def write_index(fields: DataFrame, path: str, buckets: int = BUCKETS, parts: bool = True) -> None:
    """The index of ``fields`` (``operators.index.item_fields``) at ``path``, each text tokenised once.

    Postings, in blocks of a term and some items, and term statistics lie by bucket of their term, so that a search reads the buckets of its terms only.
    Blocks do not travel: each task writes those of its items into every bucket, sorted by term, so that a frequent term is
    not one task's work. Places are delta-packed (Parquet's second format, without a dictionary)."""
    raw = index_ops.blocks_of(spread_out(fields))
    bucket = F.when(F.col("term").isNull(), -1).otherwise(index_ops.bucket_of(F.col("term"), buckets)).cast("int")
    sorted_ = raw.withColumn("bucket", bucket).sortWithinPartitions("bucket", "term")
    packed = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#block.positions.list.element": "false"}
    sorted_.write.options(**packed).partitionBy("bucket").parquet(f"{path}/postings")
    written = fields.sparkSession.read.parquet(f"{path}/postings")
    stats = written.filter("bucket >= 0").select("bucket", "term", "n_items").repartition("bucket").groupBy("bucket", "term").agg(F.sum("n_items").alias("df"))
    stats.write.partitionBy("bucket").parquet(f"{path}/term_stats")
    index_ops.totals_of(index_ops.unpacked(written.filter("bucket = -1")).select(F.col("tf").alias("n_tokens"))).coalesce(1).write.parquet(f"{path}/totals")
    if parts:
        write_parts(fields, path)


def spread_out(df: DataFrame) -> DataFrame:
    """``df`` over all cores: one that has fewer partitions, as a single file has, is dealt out row by row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_parts(fields: DataFrame, path: str) -> None:
    """The texts of the index cut into tokens, for snippets."""
    index_ops.parts_of(spread_out(fields)).write.mode("overwrite").parquet(f"{path}/parts")


def read_index(spark: SparkSession, path: str, buckets: int = BUCKETS, parts: bool = True) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    postings = read("postings")
    doc_stats = index_ops.unpacked(postings.filter("bucket = -1")).select("id", F.col("tf").alias("n_tokens"))
    return Index(index_ops.unpacked(postings.filter("bucket >= 0")), doc_stats, read("term_stats"), read("totals"), buckets, read("parts") if parts else None)


def stored_index(fields: DataFrame, name: str = "index", parts: bool = True) -> Index:
    """The index of ``fields``, written into the shared folder and read back."""
    path = scratch(fields.sparkSession, name)
    write_index(fields, path, parts=parts)
    return read_index(fields.sparkSession, path, parts=parts)


def shared_index(spark: SparkSession, sources: list[str], fields: Callable[[], DataFrame], parts: bool = False) -> Index:
    """The stored index over the tables at ``sources``, built by the first search of this application that asks for it
    and read by all later ones, until a file of the sources changes: then it is built anew and the old one deleted."""
    key = (spark.sparkContext.applicationId, *sources)
    mark = fingerprint(spark, *sources)
    known = _SHARED.get(key)
    if known is None or known[0] != mark:
        path = scratch(spark, "shared-index")
        write_index(fields(), path, parts=False)
        if known is not None:
            delete(spark, known[1])
        known = _SHARED[key] = [mark, path, False]
    if parts and not known[2]:
        write_parts(fields(), known[1])
        known[2] = True
    return read_index(spark, known[1], parts=known[2])


_SHARED: dict[tuple, list] = {}


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote, wherever Spark keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, wherever Spark keeps it; none where it is missing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


def clear_scratch(spark: SparkSession) -> None:
    """Remove every table that this application wrote for reuse; frames that read them are of no use afterwards."""
    app = spark.sparkContext.applicationId
    for path in _WRITTEN.pop(app, []):
        delete(spark, path)
    for key in [k for k in _SHARED if k[0] == app]:
        del _SHARED[key]

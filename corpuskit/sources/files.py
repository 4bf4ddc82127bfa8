"""Files as tables: ingest, delimited files, folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Type by extension, folders that are not looked into.
TYPES = {"md": "markdown", "markdown": "markdown", "txt": "text", "csv": "text", "tsv": "text", "json": "text", "jsonl": "text", "py": "text", "ts": "text", "js": "text", "html": "text", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "webp": "image", "mp4": "video", "mov": "video", "mp3": "audio", "wav": "audio"}
SKIPPED = ("node_modules", "__pycache__", "dist", "build", "target", "venv")
DELIMITERS = (",", "\t", ";", "|")


def ingest_files(spark: SparkSession, path: str, text_bytes: int = 2 << 20) -> DataFrame:
    """``path, name, extension, type, size, modified, content_hash, text``: one row a file below ``path``.

    Text is read from files of up to ``text_bytes`` whose first 8 KB hold no zero byte and less than 2 % control bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    head = F.decode(F.substring("content", 1, 8192), "ISO-8859-1")
    control = F.length(F.regexp_replace(head, "[^\\x01-\\x08\\x0E-\\x1F\\x7F]", ""))
    is_text = (F.length("content") <= text_bytes) & (F.instr(head, "\x00") == 0) & (control * 50 < F.greatest(F.length(head), F.lit(1)))
    table = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return files.select(
        "path",
        name.alias("name"),
        extension.alias("extension"),
        F.coalesce(F.try_element_at(table, extension), F.when(is_text, "text").otherwise("unknown")).alias("type"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        F.sha2("content", 256).alias("content_hash"),
        F.when(is_text, F.decode("content", "UTF-8")).alias("text"),
    )


def _cells(line: str) -> Column:
    """The cells of a line: each begins with a delimiter, one of which is put before the line."""
    pattern = F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E(\"(?:[^\"]++|\"\")*+\"|[^\\Q"), F.col("delimiter"), F.lit("\\E]*)"))
    found = F.regexp_extract_all(F.concat("delimiter", line), pattern, F.lit(1))
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r'\A"|"\z', ""), '""', '"')
    return F.transform(found, lambda c: F.when(c.rlike('(?s)^".*"$'), bare(c)).otherwise(c))


def records(files: DataFrame) -> DataFrame:
    """``path, no, line``: the records of delimited texts (``path, text``), by the number of their first line. A line
    begins a record where the lines of the file before it have an even number of quotes; else it is the rest of a cell
    in quotes. A quote that is never closed runs to the end of the file."""
    lines = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("no", "part"))
    before = Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    quotes = F.length("part") - F.length(F.replace("part", F.lit('"')))
    begins = (F.coalesce(F.sum(quotes).over(before), F.lit(0)) % 2 == 0).cast("int")
    numbered = lines.withColumn("begins", begins).withColumn("record", F.sum("begins").over(upto))
    whole = numbered.groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("no", "part"))).alias("parts"))
    return whole.select("path", F.col("parts")[0]["no"].alias("no"), F.array_join(F.transform("parts", lambda p: p["part"]), "\n").alias("line"))


def profile_delimited(files: DataFrame, shown: int = 50, most_columns: int = 64) -> DataFrame:
    """``path, delimiter, columns, n_rows, preview`` of ``path, text``: the delimiter that the header has most of
    (ties in the order comma, tab, semicolon, bar), and the first rows as ``name: value`` pairs. A cell in quotes may hold
    the delimiter, line breaks, and quotes as two; in the pairs its white space is one blank."""
    lines = records(files).filter(F.trim("line") != "").withColumn("no", F.row_number().over(Window.partitionBy("path").orderBy("no")) - 1)
    header = lines.filter("no = 0").select("path", F.col("line").alias("header"))
    counts = [F.size(F.split("header", F.lit("\\" + d if d in "|" else d))) - 1 for d in DELIMITERS]
    best = F.greatest(*counts)
    delimiter = F.coalesce(*[F.when((best > 0) & (c == best), F.lit(d)) for c, d in zip(counts, DELIMITERS, strict=True)], F.lit(","))
    header = header.withColumn("delimiter", delimiter).withColumn("columns", F.slice(_cells("header"), 1, most_columns))
    cells = _cells("line")
    rows = lines.filter("no > 0").join(header.select("path", "delimiter", "columns"), "path")
    text = F.array_join(F.zip_with("columns", F.slice(cells, 1, most_columns), lambda c, v: F.concat(c, F.lit(": "), F.regexp_replace(F.coalesce(v, F.lit("")), r"\s*[\r\n]\s*", " "))), " · ")
    body = rows.groupBy("path").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_list(F.when(F.col("no") <= shown, F.struct("no", text.alias("row"))))).alias("r"))
    return header.join(body, "path", "left").select("path", "delimiter", "columns", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.transform("r", lambda x: x["row"]).alias("preview"))


def folder_manifest(paths: DataFrame, max_depth: int = 4, max_files: int = 500, top: int = 20, entries: int = 60) -> DataFrame:
    """``root, n_files, n_dirs, bytes, truncated, extensions, entries`` of ``root, rel, size``: hidden and built folders
    are skipped; folders are those above the files that count, entries the first names of the top level, a folder's
    with a slash."""
    parts = F.split("rel", "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(*SKIPPED))
    seen = paths.filter(~hidden & (F.size(parts) <= max_depth))
    ranked = seen.withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy("rel")))
    kept = ranked.filter(F.col("nth") <= max_files).withColumn("ext", F.lower(F.regexp_extract("rel", r"\.([A-Za-z0-9]+)$", 1)))
    totals = ranked.groupBy("root").agg(F.count_if(F.col("nth") <= max_files).alias("n_files"), F.sum(F.when(F.col("nth") <= max_files, F.col("size"))).alias("bytes"), (F.max("nth") > max_files).alias("truncated"))
    counts = kept.groupBy("root", "ext").agg(F.count("*").alias("n"))
    counts = counts.withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("n"), "ext"))).filter(F.col("r") <= top)
    names = kept.select("root", F.split("rel", "/").alias("p"))
    above = names.select("root", F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.array_join(F.slice("p", 1, i), "/"))).alias("dir")).filter("dir <> ''")
    dirs = above.groupBy("root").agg(F.count_distinct("dir").alias("n_dirs"))
    tops = names.select("root", F.when(F.size("p") > 1, F.concat(F.col("p")[0], F.lit("/"))).otherwise(F.col("p")[0]).alias("entry")).distinct()
    tops = tops.withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy("entry"))).filter(F.col("r") <= entries)
    tops = tops.groupBy("root").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    extensions = counts.groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("extensions"))
    out = totals.join(extensions, "root", "left").join(dirs, "root", "left").join(tops, "root", "left")
    return out.withColumn("n_dirs", F.coalesce("n_dirs", F.lit(0))).select("root", "n_files", "n_dirs", "bytes", "truncated", "extensions", "entries")


def folder_tree(paths: DataFrame) -> DataFrame:
    """``root, dir, depth, n_files, n_dirs, bytes`` of every folder above a file of ``root, rel, size``, the root itself
    as the empty name: all files and folders below it, none left out by depth or number. Hidden and built ones are
    skipped. A file counts once for each folder above it, summed where it is read."""
    parts = F.split("rel", "/")
    seen = paths.filter(~F.exists(parts, lambda p: p.startswith(".") | p.isin(*SKIPPED))).select("root", parts.alias("p"), F.coalesce("size", F.lit(0)).alias("size"))
    prefix = lambda i: F.array_join(F.slice("p", 1, i), "/")
    above = seen.select("root", F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.struct(prefix(i).alias("dir"), i.alias("depth")))).alias("a"), "size")
    dirs = above.groupBy("root", "a.dir", "a.depth").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))
    over = dirs.filter("depth > 0").select("root", F.split("dir", "/").alias("p"))
    inside = over.select("root", F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - 1), prefix)).alias("dir")).groupBy("root", "dir").agg(F.count("*").alias("n_dirs"))
    return dirs.join(inside, ["root", "dir"], "left").select("root", "dir", "depth", "n_files", F.coalesce("n_dirs", F.lit(0)).alias("n_dirs"), "bytes")

"""Item records: patches of their metadata, annotations that respect what a person set, samples of folders, drops."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fields that a person can hold fast; stages in which an item rests; text files that folders show first.
OVERRIDABLE = ("title", "understanding", "why_useful", "kind", "topics", "entities")
RESTING = ("READY", "PARTIAL")
FIRST_TEXTS, THEN_CONFIG = ("md", "markdown", "txt", "rst"), ("yaml", "yml", "toml", "json")
LOCK_FILES = r"(^|/)(package-lock\.json|pnpm-lock\.yaml|yarn\.lock|Cargo\.lock|poetry\.lock)$"
TEXT_FILES = (*FIRST_TEXTS, *THEN_CONFIG, "py", "ts", "js", "go", "rs", "java", "c", "h", "cpp", "rb", "sh", "css", "html", "csv", "tsv", "sql", "xml")


def _patched(value, patch):
    """RFC 7396: objects merge, null deletes, anything else replaces."""
    if not isinstance(patch, dict):
        return patch
    out = dict(value) if isinstance(value, dict) else {}
    for key, change in patch.items():
        if change is None:
            out.pop(key, None)
        else:
            out[key] = _patched(out.get(key), change)
    return out


def merge_patches(items: DataFrame, patches: DataFrame) -> DataFrame:
    """``id, metadata`` (JSON text) after the patches (``id, seq, patch``) of each item, in order of ``seq``. Only items
    with patches are shuffled with them; broken patches change nothing."""
    named = patches.select("id").distinct()
    base = items.join(named, "id", "left_semi").select("id", F.lit(None).cast("long").alias("seq"), F.col("metadata").alias("patch"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        value = {}
        for text in group.sort_values("seq", na_position="first", kind="stable")["patch"]:
            try:
                value = _patched(value, json.loads(text))
            except (TypeError, ValueError):
                continue
        return pd.DataFrame({"id": [group["id"].iloc[0]], "metadata": [json.dumps(value, ensure_ascii=False)]})

    rows = base.unionByName(patches.join(items.select("id"), "id", "left_semi").select("id", F.col("seq").cast("long").alias("seq"), "patch"))
    changed = rows.groupBy("id").applyInPandas(fold, f"id {dict(items.dtypes)['id']}, metadata string")
    return items.select("id", "metadata").join(named, "id", "left_anti").unionByName(changed)


def merge_annotations(items: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``items`` with the fields of ``annotations`` (the same names, and ``visual, visible, hints, confidence``), but for
    those that ``overrides`` (a map) holds fast; and ``id, skipped``: the fields that were kept so. A blank title keeps
    the old one."""
    new = annotations.select("id", F.lit(True).alias("_has"), *(F.col(f).alias(f"_{f}") for f in (*OVERRIDABLE, "visual", "visible", "hints", "confidence")))
    both = items.join(new, "id", "left")
    held = lambda f: F.coalesce(F.try_element_at("overrides", F.lit(f)), F.lit(False))
    take = lambda f: F.when(F.trim(F.coalesce("_title", F.lit(""))) == "", F.col("title")).otherwise(F.trim("_title")) if f == "title" else F.col(f"_{f}")
    fields = {f: F.when(F.col("_has") & ~held(f), take(f)).otherwise(F.col(f)) for f in OVERRIDABLE}
    parts = F.filter(F.array("_visual", "_visible"), lambda s: F.trim(s) != "")
    vision = F.when(F.size(parts) > 0, F.array_join(parts, "\n\n"))
    fields["vision_text"] = F.when(F.col("_has"), vision).otherwise(F.col("vision_text"))
    fields["retrieval_hints"] = F.when(F.col("_has"), F.col("_hints")).otherwise(F.col("retrieval_hints"))
    fields["ai_confidence"] = F.when(F.col("_has"), F.col("_confidence")).otherwise(F.col("ai_confidence"))
    merged = both.select(*(fields.get(c, F.col(c)).alias(c) for c in items.columns))
    skipped = both.filter("_has").select("id", F.filter(F.array(*(F.when(held(f), F.lit(f)) for f in OVERRIDABLE)), lambda f: f.isNotNull()).alias("skipped")).filter(F.size("skipped") > 0)
    return merged, skipped


def settle_trashed(items: DataFrame) -> DataFrame:
    """Items in the trash that were still in work become PARTIAL; those that rest or failed stay as they are."""
    at_rest = F.col("status").isin(*RESTING) | F.col("status").endswith("_FAILED")
    return items.withColumn("status", F.when(F.col("deleted") & ~F.coalesce(at_rest, F.lit(False)), "PARTIAL").otherwise(F.col("status")))


def union_lists(a: Column, b: Column, cap: int) -> Column:
    """``a``, then the members of ``b`` that are not there yet whatever their case, up to ``cap`` in all; ``a`` is never cut."""
    start = F.coalesce(a, F.array().cast("array<string>"))
    has = lambda acc, x: F.exists(acc, lambda y: F.lower(y) == F.lower(x))
    return F.aggregate(F.coalesce(b, F.array().cast("array<string>")), start, lambda acc, x: F.when((F.size(acc) >= cap) | has(acc, x), acc).otherwise(F.concat(acc, F.array(x))))


def choose_samples(files: DataFrame, k: int = 20, most_bytes: int = 64 * 1024) -> DataFrame:
    """``root, rel, pos``: the README of each root (place 0; the nearest to the root) and its first ``k`` small text
    files by depth, kind and path. files: ``root, rel, size``."""
    depth = F.length("rel") - F.length(F.replace("rel", F.lit("/")))
    ext = F.lower(F.regexp_extract("rel", r"\.([A-Za-z0-9]+)$", 1))
    rank = F.when(ext.isin(*FIRST_TEXTS), 0).when(ext.isin(*THEN_CONFIG), 1).otherwise(2)
    named = files.select("root", "rel", "size", depth.alias("depth"), ext.alias("ext"), rank.alias("rank"), F.regexp_extract("rel", r"([^/]*)$", 1).rlike(r"(?i)^readme(\.|$)").alias("readme"))
    first = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("readme"), "depth", "rel", "size"))
    marked = named.withColumn("pos", F.when(F.col("readme") & (first == 1), 0))
    fit = (F.col("size") > 0) & (F.col("size") <= most_bytes) & F.col("ext").isin(*TEXT_FILES) & ~F.col("rel").rlike(LOCK_FILES)
    order = F.row_number().over(Window.partitionBy("root").orderBy("depth", "rank", "rel"))
    rest = marked.filter(F.col("pos").isNull() & fit).withColumn("pos", order).filter(F.col("pos") <= k)
    return marked.filter("pos = 0").unionByName(rest).select("root", "rel", "pos")


def resolve_drops(drops: DataFrame, canonical) -> DataFrame:
    """``batch_id, kind, value, source_url``: what a drop keeps. drops: ``batch_id, pos, kind`` (file, url, text), ``value``.

    Links win over files that are nothing but shortcuts; files win over addresses that are all media, the first of
    which is kept as their source; a text that is one address is a link; a text beside links or files goes; links that
    are one address canonically are kept once. ``canonical`` maps an address column to its canonical form."""
    media = r"(?i)\.(png|jpe?g|gif|webp|heic|heif|avif|bmp|tiff?|svg|mp4|mov|webm|m4v|mp3|m4a|wav|aac|ogg)([?#]|$)"
    is_file, is_url, is_text = (F.col("kind") == x for x in ("file", "url", "text"))
    every = Window.partitionBy("batch_id")
    none = lambda c: F.coalesce(F.max(F.when(c, 1)).over(every), F.lit(0)) == 0
    d = drops.withColumns({
        "no_file": none(is_file), "no_url": none(is_url),
        "only_shortcuts": none(is_file & ~F.col("value").rlike(r"(?i)\.(webloc|url)$")),
        "only_media": none(is_url & ~F.col("value").rlike(media)),
        "first_url": F.min(F.when(is_url, F.struct("pos", "value"))).over(every)["value"],
    })
    drop_files = ~F.col("no_url") & ~F.col("no_file") & F.col("only_shortcuts")
    drop_urls = ~F.col("no_file") & ~F.col("no_url") & F.col("only_media") & ~F.col("only_shortcuts")
    lone = is_text & F.trim("value").rlike(r"^https?://\S+$") & (F.col("no_url") | drop_urls)
    kept = d.withColumn("kind", F.when(lone, "url").otherwise(F.col("kind"))).withColumn("links", F.coalesce(F.max(F.when(lone | (is_url & ~drop_urls), 1)).over(every), F.lit(0)) == 1)
    kept = kept.filter((is_file & ~drop_files) | (is_url & (lone | ~drop_urls)) | (is_text & F.col("no_file") & ~F.col("links") & (F.trim("value") != "")))
    kept = kept.withColumn("key", F.when(is_url, canonical(F.trim("value")))).filter(~is_url | F.col("key").isNotNull())
    nth = F.row_number().over(Window.partitionBy("batch_id", "kind", F.coalesce("key", F.col("pos").cast("string"))).orderBy("pos"))
    return kept.withColumn("nth", nth).filter("nth = 1").select("batch_id", "kind", F.trim("value").alias("value"), F.when(is_file & drop_urls, F.col("first_url")).alias("source_url"))


#: What of an item's metadata is searched.
META_SCHEMA = "description string, siteName string, originalName string, sourceUrl string, headings array<string>, og struct<title: string, description: string, siteName: string>, repo struct<owner: string, name: string, description: string, language: string, topics: array<string>>, folder struct<extensions: map<string, string>>"


def meta_text(metadata: Column) -> Column:
    """The searched texts of a JSON metadata column, joined by blanks: the description, the names of site, file and
    source, headings, what the page, the repository and the folder are. Broken JSON and other types give nothing."""
    m = F.from_json(metadata, META_SCHEMA)
    one = lambda *fields: [F.array(F.trim(m[f] if "." not in f else m[f.split(".")[0]][f.split(".")[1]])) for f in fields]
    lists = [*one("description", "siteName", "originalName", "sourceUrl"), m["headings"], *one("og.title", "og.description", "og.siteName", "repo.owner", "repo.name", "repo.description", "repo.language"), m["repo"]["topics"], F.array_sort(F.map_keys(m["folder"]["extensions"]))]
    none = F.array().cast("array<string>")
    return F.array_join(F.filter(F.concat(*(F.coalesce(x, none) for x in lists)), lambda t: t.isNotNull() & (t != "")), " ")

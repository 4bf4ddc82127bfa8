"""Web pages: what their heads say of them, and the text that they carry. Pages are read by ``markup``; the rest is expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.markup import read_pages
from corpuskit.operators.preparation import canonical_url, type_links

# Where each fact of a page is looked for, the first place that has it.
SOURCES = {
    "title": ("property=og:title", "name=twitter:title"),
    "description": ("name=description", "property=og:description", "name=twitter:description"),
    "site_name": ("property=og:site_name", "name=application-name"),
    "image": ("property=og:image", "name=twitter:image"),
    "og_type": ("property=og:type",),
    "published": ("property=article:published_time", "name=article:published_time", "name=date", "name=pubdate", "name=publish_date", "property=og:updated_time", "name=citation_date", "name=citation_publication_date", "name=dc.date", "name=dc.date.issued"),
    "byline": ("name=author", "property=article:author", "name=twitter:creator"),
}
#: A block of this many characters, or one that ends as a sentence, is text; with more of it in links it is a menu.
BLOCK_CHARS, LINK_SHARE = 40, 0.5
#: Below this many characters a page's text is but a part, and from ``READABLE`` on it is an article.
PARTIAL, READABLE = 400, 1500


def clean(s: Column, n: int = 1000) -> Column:
    """White space collapsed, at most ``n`` characters; null for nothing."""
    flat = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(flat != "", F.substring(flat, 1, n))


def absolute(href: Column, base: Column) -> Column:
    """An address against that of its page."""
    scheme = F.regexp_extract(base, r"(?i)^(https?):", 1)
    origin = F.regexp_extract(base, r"(?i)^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"(?i)^(https?://[^?#]*/)", 1)
    below = F.when(F.length(folder) > F.length(origin), folder).otherwise(F.concat(origin, F.lit("/")))
    return F.when(href.rlike(r"(?i)^https?://"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("/"), F.concat(origin, href)).when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string")).when(href != "", F.concat(below, href))


def page_tags(pages: DataFrame) -> DataFrame:
    """``page_id, pos, tag, key, value``: the tags of a page that say something of it: ``meta`` by name or property,
    ``link`` by rel, the ``title``, the language of ``html``, ``time``, types, dates and authors in JSON-LD."""
    return read_pages(pages).select("page_id", F.posexplode("tags").alias("pos", "t")).select("page_id", "pos", "t.*")


def page_metadata(pages: DataFrame) -> DataFrame:
    """``page_id, title, description, canonical, site_name, image, og_type, lang, favicon, published, byline, ld_types``.

    Each fact comes from the first of its places that has it. The icon is the largest declared one up to 512 points, by
    default ``/favicon.ico``. A page is one row throughout: tags are grouped by page, and ``url`` is its address."""
    tags = page_tags(pages)
    rank = lambda places: F.coalesce(*(F.when(F.col("key") == p, n) for n, p in enumerate(places)))
    best = {k: F.min_by("value", F.when((F.col("tag") == "meta") & rank(v).isNotNull(), F.struct(rank(v), "pos"))).alias(k) for k, v in SOURCES.items()}
    only = lambda tag: F.min_by("value", F.when(F.col("tag") == tag, F.col("pos"))).alias(f"_{tag}")
    canonical = F.min_by("value", F.when((F.col("tag") == "link") & F.col("key").startswith("canonical|"), F.col("pos"))).alias("_canonical")
    og_url = F.min_by("value", F.when(F.col("key") == "property=og:url", F.col("pos"))).alias("_og_url")
    icon = (F.col("tag") == "link") & F.col("key").rlike(r"^([^|]* )?(icon|apple-touch-icon)( [^|]*)?\|")
    points = F.when(F.col("key").contains("apple-touch"), 180).otherwise(F.coalesce(F.regexp_extract("key", r"(\d+)x\d+", 1).try_cast("int"), F.lit(32)))
    favicon = F.max_by("value", F.when(icon & (points <= 512), F.struct(points, -F.col("pos")))).alias("_icon")
    types = F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("key") == "type", F.struct("pos", "value")))), lambda x: x["value"])), 1, 10).alias("ld_types")
    said = lambda key: F.min_by("value", F.when((F.col("tag") == "ld") & (F.col("key") == key), F.col("pos"))).alias(f"_{key}")
    facts = tags.groupBy("page_id").agg(*best.values(), only("title"), only("lang"), only("time"), said("date"), said("author"), canonical, og_url, favicon, types)
    rows = pages.select("page_id", "url").join(facts, "page_id", "left")
    base = F.coalesce("url", F.lit(""))
    byline = clean(F.col("byline"), 120)
    return rows.select(
        "page_id",
        F.coalesce(clean(F.col("title")), clean(F.col("_title"), 300)).alias("title"),
        clean(F.col("description")).alias("description"),
        F.coalesce(absolute(clean(F.col("_canonical")), base), absolute(clean(F.col("_og_url")), base)).alias("canonical"),
        clean(F.col("site_name")).alias("site_name"),
        absolute(clean(F.col("image")), base).alias("image"),
        F.lower(clean(F.col("og_type"))).alias("og_type"),
        F.substring(clean(F.col("_lang")), 1, 16).alias("lang"),
        F.coalesce(absolute(clean(F.col("_icon"), 2000), base), absolute(F.lit("/favicon.ico"), base)).alias("favicon"),
        F.coalesce(clean(F.col("published")), clean(F.col("_time")), clean(F.col("_date"))).alias("published"),
        F.coalesce(F.when(~byline.rlike("^https?:"), F.regexp_replace(byline, "^@", "")), clean(F.col("_author"), 120)).alias("byline"),
        F.coalesce("ld_types", F.array().cast("array<string>")).alias("ld_types"),
    )


def paper_facts(pages: DataFrame) -> DataFrame:
    """``page_id, title, authors, abstract, published, pdf_url, doi`` of pages that cite themselves as papers: those with
    a ``citation_`` tag, which is taken first; the abstract may be the description."""
    tags = page_tags(pages).filter("tag = 'meta'").withColumn("value", clean(F.col("value"), 10_000))
    first = lambda *names: F.coalesce(*(F.min_by("value", F.when(F.col("key") == f"name={n}", F.col("pos"))) for n in names))
    authors = F.transform(F.array_sort(F.collect_list(F.when(F.col("key") == "name=citation_author", F.struct("pos", "value")))), lambda a: a["value"])
    facts = tags.groupBy("page_id").agg(
        F.bool_or(F.col("key").startswith("name=citation_")).alias("cited"),
        F.substring(first("citation_title"), 1, 300).alias("title"),
        authors.alias("authors"),
        first("citation_abstract", "description").alias("abstract"),
        F.replace(first("citation_date", "citation_online_date"), F.lit("/"), F.lit("-")).alias("published"),
        first("citation_pdf_url").alias("pdf_url"),
        first("citation_doi").alias("doi"),
    )
    return facts.filter("cited").drop("cited")


def page_text(pages: DataFrame, excerpt: int = 280) -> DataFrame:
    """``page_id, text, length, partial, excerpt``: the blocks of a page that read as text, a line each.

    Our own rule: what is no page's own (scripts, menus, heads and feet) goes, tags that part blocks become line ends, and
    a block stays that is long enough or ends as a sentence and is not mostly links. Without any the title stands in."""
    good = F.filter("blocks", lambda b: (F.length(b["t"]) > 0) & ((F.length(b["t"]) >= BLOCK_CHARS) | b["t"].rlike(r"[.!?…]$")) & (F.length(b["own"]) >= F.length(b["t"]) * (1 - LINK_SHARE)))
    text = F.array_join(F.transform(good, lambda b: b["t"]), "\n")
    titles = F.filter("tags", lambda t: t["tag"] == "title")
    title = F.coalesce(clean(F.get(titles, F.lit(0))["value"], 300), F.lit(""))
    rows = read_pages(pages).select("page_id", F.when(text != "", text).otherwise(title).alias("text"))
    flat = F.regexp_replace("text", r"\s+", " ")
    cut = F.when(F.length(flat) <= excerpt, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, excerpt - 1)), F.lit("…")))
    return rows.select("page_id", "text", F.length("text").alias("length"), (F.length("text") < PARTIAL).alias("partial"), cut.alias("excerpt"))


def refine_types(links: DataFrame, metadata: DataFrame, texts: DataFrame) -> DataFrame:
    """``id, kind, key``: the kinds of ``type_links``, and of generic links what their pages say: a video or an article by
    og:type or JSON-LD, an article too where the text is long."""
    typed = type_links(links).join(metadata.select(F.col("page_id").alias("id"), "og_type", "ld_types"), "id", "left").join(texts.select(F.col("page_id").alias("id"), "length"), "id", "left")
    said = lambda pattern: F.coalesce(F.col("og_type").rlike(pattern), F.lit(False)) | F.coalesce(F.exists("ld_types", lambda t: F.lower(t).rlike(pattern)), F.lit(False))
    kind = F.when(F.col("kind") != "generic", F.col("kind")).when(said(r"^video|videoobject"), "video").when(said(r"article|blogposting"), "article").when(F.col("length") >= READABLE, "article").otherwise("generic")
    return typed.select("id", kind.alias("kind"), "key")


def page_links(pages: DataFrame) -> DataFrame:
    """``page_id, target, n``: the addresses that a page links to, canonical, with how often."""
    rows = read_pages(pages).select("page_id", "url", F.explode("links").alias("href")).filter("href <> ''")
    return rows.select("page_id", canonical_url(absolute(F.col("href"), F.col("url"))).alias("target")).filter("target IS NOT NULL").groupBy("page_id", "target").agg(F.count("*").alias("n"))

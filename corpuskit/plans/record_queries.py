"""Registered queries of records, pages, drops and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions import text as text_functions
from corpuskit.functions.text import estimate_tokens
from corpuskit.operators import analytics, curation, pages, preparation, records, vectors, views
from corpuskit.plans import model
from corpuskit.plans.catalog import query
from corpuskit.sources import tables

KIND_LABELS = {"article": "Article", "paper": "Paper", "docs": "Documentation", "library": "Library", "note": "Note"}


def _docs(spark, sf_dir):
    return model.table(spark, sf_dir, "documents")


def metadata(spark, sf_dir):
    """``id, metadata``: JSON as items carry it."""
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.to_json(F.struct(F.struct(F.coalesce("source", F.lit("none")).alias("owner"), F.col("doc_id").alias("stars")).alias("repo"), F.lit("kept").alias("note"))).alias("metadata"))


METADATA = """meta AS (SELECT doc_id AS id, json_object('repo', json_object('owner', coalesce(source, 'none'), 'stars', doc_id), 'note', 'kept') AS metadata FROM documents)"""


@query("merge_patches", f"""WITH {METADATA}, m AS (SELECT id, CASE WHEN id % 3 = 0 THEN json_merge_patch(json_merge_patch(metadata, '{{"note": null}}'), json_object('repo', json_object('stars', id + 1), 'tags', json_array('x'))) WHEN id % 3 = 1 THEN json_merge_patch(metadata, '{{"repo": {{"stars": null, "deep": {{"er": true}}}}}}') ELSE metadata END AS m FROM meta)
SELECT id, m->>'$.note' AS note, m->>'$.repo.owner' AS owner, CAST(m->>'$.repo.stars' AS BIGINT) AS stars, m->>'$.repo.deep.er' AS deep FROM m""")
def merge_patches(spark, sf_dir):
    items = metadata(spark, sf_dir)
    patch = lambda rest, seq, text: items.filter(f"id % 3 = {rest}").select("id", F.lit(seq).alias("seq"), text.alias("patch"))
    second = F.to_json(F.struct(F.struct((F.col("id") + 1).alias("stars")).alias("repo"), F.array(F.lit("x")).alias("tags")))
    patches = patch(0, 2, second).unionByName(patch(0, 1, F.lit('{"note": null}'))).unionByName(patch(1, 1, F.lit('{"repo": {"stars": null, "deep": {"er": true}}}'))).unionByName(patch(1, 2, F.lit("{broken")))
    m = records.merge_patches(items, patches)
    at = lambda p: F.get_json_object("metadata", p)
    return m.select("id", at("$.note").alias("note"), at("$.repo.owner").alias("owner"), at("$.repo.stars").cast("long").alias("stars"), at("$.repo.deep.er").alias("deep"))


@query("merge_annotations", """SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 OR doc_id % 2 = 0 THEN 'old title' ELSE concat('about ', source) END AS title, CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 'old' ELSE coalesce(lang, 'none') END AS topics,
CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'seen' ELSE 'seen' || chr(10) || chr(10) || 'read' END END AS vision_text FROM documents""")
def merge_annotations(spark, sf_dir):
    d = _docs(spark, sf_dir)
    none, old = F.lit(None).cast("string"), F.array(F.lit("old"))
    held = F.map_from_arrays(F.array(F.lit("title"), F.lit("topics")), F.array(F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0))
    items = d.select(F.col("doc_id").alias("id"), F.lit("old title").alias("title"), none.alias("understanding"), none.alias("why_useful"), none.alias("kind"), old.alias("topics"), old.alias("entities"), held.alias("overrides"), none.alias("vision_text"), old.alias("retrieval_hints"), F.lit(0.0).alias("ai_confidence"))
    new = d.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.concat(F.lit(" about "), F.coalesce("source", F.lit(""))).alias("title"), none.alias("understanding"), none.alias("why_useful"), none.alias("kind"), F.array(F.coalesce("lang", F.lit("none"))).alias("topics"), old.alias("entities"), F.lit("seen").alias("visual"), F.when(F.col("doc_id") % 4 == 0, " ").otherwise("read").alias("visible"), old.alias("hints"), F.lit(0.5).alias("confidence"))
    merged, _ = records.merge_annotations(items, new)
    return merged.select("id", "title", F.array_join("topics", ",").alias("topics"), "vision_text")


@query("skipped_annotations", "SELECT doc_id AS id, CASE WHEN doc_id % 6 = 0 THEN 'title,topics' WHEN doc_id % 2 = 0 THEN 'title' ELSE 'topics' END AS skipped FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def skipped_annotations(spark, sf_dir):
    d, none = _docs(spark, sf_dir), F.lit(None).cast("string")
    held = F.map_from_arrays(F.array(F.lit("title"), F.lit("topics")), F.array(F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0))
    fields = [none.alias(c) for c in ("title", "understanding", "why_useful", "kind", "topics", "entities", "vision_text", "retrieval_hints")]
    items = d.select(F.col("doc_id").alias("id"), *fields, held.alias("overrides"), F.lit(0.0).alias("ai_confidence"))
    new = d.select(F.col("doc_id").alias("id"), *fields, none.alias("visual"), none.alias("visible"), none.alias("hints"), F.lit(0.5).alias("confidence"))
    return records.merge_annotations(items, new)[1].select("id", F.array_join("skipped", ",").alias("skipped"))


@query("settle_trashed", f"WITH {model.ITEMS} SELECT id, CASE WHEN deleted AND id % 4 IN (0, 1) THEN 'PARTIAL' ELSE (['EXTRACTING', 'RELATING', 'READY', 'AI_FAILED'])[CAST(id % 4 AS INT) + 1] END AS status FROM items")
def settle_trashed(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("EXTRACTING", "RELATING", "READY", "AI_FAILED"))), (F.col("id") % 4 + 1).cast("int"))
    return records.settle_trashed(model.items(spark, sf_dir).withColumn("status", status)).select("id", "status")


_REL = "CASE doc_id % 7 WHEN 0 THEN 'README.md' WHEN 1 THEN concat('src/a', doc_id, '.py') WHEN 2 THEN concat('docs/x/', doc_id, '.md') WHEN 3 THEN 'sub/yarn.lock' WHEN 4 THEN concat('img/', doc_id, '.png') WHEN 5 THEN concat(doc_id, '.json') ELSE concat('readme-not/', doc_id, '.TXT') END"


@query("choose_samples", f"""WITH f AS (SELECT coalesce(source, 'none') AS root, {_REL} AS rel, n_chars * 20 AS size FROM documents), d AS (SELECT *, length(rel) - length(replace(rel, '/', '')) AS depth, lower(regexp_extract(rel, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM f),
r AS (SELECT *, CASE WHEN ext IN ('md', 'txt') THEN 0 WHEN ext = 'json' THEN 1 ELSE 2 END AS rank, row_number() OVER (PARTITION BY root ORDER BY rel = 'README.md' DESC, depth, rel, size) AS nth FROM d)
SELECT root, rel, 0 AS pos FROM r WHERE nth = 1 AND rel = 'README.md' UNION ALL SELECT root, rel, pos FROM (SELECT root, rel, row_number() OVER (PARTITION BY root ORDER BY depth, rank, rel) AS pos FROM r WHERE NOT (nth = 1 AND rel = 'README.md') AND size > 0 AND size <= 65536 AND ext IN ('md', 'txt', 'json', 'py')) WHERE pos <= 20""")
def choose_samples(spark, sf_dir):
    files = _docs(spark, sf_dir).select(F.coalesce("source", F.lit("none")).alias("root"), F.expr(_REL).alias("rel"), (F.col("n_chars") * 20).alias("size"))
    return records.choose_samples(files)


@query("resolve_drops")
def resolve_drops(spark, sf_dir):
    """Pages dropped four at a time: links beside shortcut files, media beside image files, and texts."""
    p = model.table(spark, sf_dir, "pages")
    n = F.col("page_id")
    kind = F.when(n % 4 == 3, F.when(n % 8 == 3, "file").otherwise("text")).otherwise("url")
    value = F.when(kind == "file", F.when(n % 16 == 3, "link.webloc").otherwise("photo.png")).when(kind == "text", F.concat(F.lit("about "), "url")).when(F.floor(n / 4) % 5 == 1, F.concat("url", F.lit(".png"))).otherwise(F.col("url"))
    drops = p.select(F.floor(n / 4).cast("long").alias("batch_id"), (n % 4).cast("int").alias("pos"), kind.alias("kind"), value.alias("value"))
    return records.resolve_drops(drops, preparation.canonical_url)


@query("read_rows", """SELECT doc_id AS id, CASE WHEN doc_id % 5 IN (0, 1) THEN '' ELSE concat_ws(',', 'a', coalesce(source, 'none')) END AS topics, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id END AS n FROM documents""")
def read_rows(spark, sf_dir):
    d = F.col("doc_id")
    listed = F.when(d % 5 == 0, "[broken").when(d % 5 == 1, '{"a": 1}').otherwise(F.concat(F.lit('["a", 7, '), F.concat(F.lit('"'), F.coalesce("source", F.lit("none")), F.lit('"')), F.lit(", null, {}]")))
    rows = _docs(spark, sf_dir).select(d.alias("id"), listed.alias("topics"), F.when(d % 5 == 0, "{").otherwise(F.concat(F.lit('{"n": '), d.cast("string"), F.lit("}"))).alias("meta"))
    return tables.read_rows(rows, ["topics"], {"meta": "n long"}).select("id", F.array_join("topics", ",").alias("topics"), "meta.n")


@query("union_lists", "SELECT doc_id AS id, concat_ws(',', 'Topic', coalesce(lang, 'none'), CASE WHEN lang = 'x' THEN NULL ELSE 'x' END) AS topics FROM documents")
def union_lists(spark, sf_dir):
    b = F.array(F.lit("TOPIC"), F.coalesce("lang", F.lit("none")), F.lit("x"), F.lit("X"), F.lit("y"))
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.array_join(records.union_lists(F.array(F.lit("Topic")), b, 3), ",").alias("topics"))


@query("memory_docs", rf"""WITH {model.ITEMS} SELECT id, concat_ws(chr(10), title, CASE kind WHEN 'article' THEN 'Article' WHEN 'paper' THEN 'Paper' WHEN 'docs' THEN 'Documentation' WHEN 'library' THEN 'Library' ELSE 'Note' END, CASE WHEN trim(domain) <> '' THEN domain END, CASE WHEN lang = 'en' THEN 'An English text' END,
  kind || ', ' || type, CASE WHEN length(extracted_text) > 1200 THEN regexp_replace(substring(extracted_text, 1, 1199), '\s+$', '') || '…' WHEN trim(extracted_text, ' ') <> '' THEN extracted_text END, CASE WHEN lang = 'en' THEN NULL ELSE 'excerpt' END) AS text FROM items""")
def memory_docs(spark, sf_dir):
    items = model.items(spark, sf_dir).withColumns({"understanding": F.when(F.col("lang") == "en", "An English text"), "topics": F.array("kind", "type"), "vision_text": F.col("extracted_text"), "excerpt": F.lit("excerpt")})
    return preparation.memory_docs(items, KIND_LABELS)


@query("skip_children", "WITH i AS (SELECT doc_id AS id, CASE WHEN doc_id % 60 <> 0 THEN doc_id // 60 * 60 END AS parent_id, doc_id % 11 = 10 AS deleted FROM documents) SELECT id FROM i WHERE parent_id IN (SELECT parent_id FROM i WHERE NOT deleted AND parent_id IS NOT NULL GROUP BY parent_id HAVING count(*) > 50)")
def skip_children(spark, sf_dir):
    items = model.items(spark, sf_dir).withColumn("parent_id", F.when(F.col("id") % 60 != 0, F.floor(F.col("id") / 60) * 60))
    return preparation.skip_children(items)


_UNESCAPE = "{x}"
for _entity, _plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
    _UNESCAPE = f"replace({_UNESCAPE}, '{_entity}', '" + _plain.replace("'", "''") + "')"
_BLOCKS = r"(?i)</?(p|div|article|section|main|h[1-6]|li|ul|ol|table|tr|td|th|blockquote|pre|br|hr|figure|figcaption|dl|dt|dd|form|body|html)\b[^>]*>"
_FURNITURE = r"(?is)<(script|style|noscript|template|svg|nav|header|footer|aside|form|iframe|head)\b[^>]*>.*?</(script|style|noscript|template|svg|nav|header|footer|aside|form|iframe|head)>"
_CLEAN = "trim(regexp_replace(" + _UNESCAPE + r", '\s+', ' ', 'g'))"


@query("page_metadata", rf"""WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(script|style|noscript|template)\b[^>]*>.*?</(script|style|noscript|template)>', ' ', 'g') AS h FROM pages),
t AS (SELECT *, {_CLEAN.format(x=r"regexp_extract(h, '(?is)<title\b[^>]*>(.*?)</title>', 1)")} AS title, regexp_extract(h, '(?is)<html\b[^>]*\slang="([^"]*)"', 1) AS lang FROM p)
SELECT page_id, CASE WHEN title <> '' THEN substring(title, 1, 300) END AS title, CASE WHEN lang <> '' THEN lang END AS lang, regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1) || '/favicon.ico' AS favicon, CAST(NULL AS VARCHAR) AS canonical FROM t""")
def page_metadata(spark, sf_dir):
    return pages.page_metadata(model.table(spark, sf_dir, "pages")).select("page_id", "title", "lang", "favicon", "canonical")


@query("page_text", rf"""WITH b AS (SELECT page_id, html, regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g'), '{_FURNITURE}', chr(10), 'g') AS h FROM pages),
s AS (SELECT page_id, html, string_split(regexp_replace(regexp_replace(h, '[\r\n]+', ' ', 'g'), '{_BLOCKS}', chr(10), 'g'), chr(10)) AS blocks FROM b),
c AS (SELECT page_id, html, list_transform(blocks, lambda x: {{'t': trim(regexp_replace({_UNESCAPE.format(x=r"regexp_replace(x, '<[^>]*>', ' ', 'g')")}, '\s+', ' ', 'g')), 'own': trim(regexp_replace({_UNESCAPE.format(x=r"regexp_replace(regexp_replace(x, '(?i)<a\b[^>]*>.*?</a>', ' ', 'g'), '<[^>]*>', ' ', 'g')")}, '\s+', ' ', 'g'))}}) AS c FROM s),
g AS (SELECT page_id, {_CLEAN.format(x=r"regexp_extract(coalesce(html, ''), '(?is)<title\b[^>]*>(.*?)</title>', 1)")} AS title, array_to_string(list_transform(list_filter(c, lambda b: length(b.t) > 0 AND (length(b.t) >= 40 OR regexp_matches(b.t, '[.!?…]$')) AND length(b.own) >= length(b.t) * 0.5), lambda b: b.t), chr(10)) AS text FROM c)
SELECT page_id, CASE WHEN text <> '' THEN text ELSE substring(title, 1, 300) END AS text, length(CASE WHEN text <> '' THEN text ELSE substring(title, 1, 300) END) AS length, length(CASE WHEN text <> '' THEN text ELSE substring(title, 1, 300) END) < 400 AS partial FROM g""")
def page_text(spark, sf_dir):
    return pages.page_text(model.table(spark, sf_dir, "pages")).select("page_id", "text", "length", "partial")


@query("page_links", r"""WITH l AS (SELECT page_id, regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1) AS origin, unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g'), '(?is)<a\b[^>]*?\shref="([^"]+)"', 1)) AS href FROM pages),
a AS (SELECT page_id, CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '/%' THEN origin || href END AS u FROM l)
SELECT page_id, 'https://' || regexp_replace(lower(regexp_extract(u, '^https?://([^/?#:]+)', 1)), '^(www|m|mobile|amp)\.', '') || regexp_replace(regexp_replace(regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1), '/+$', ''), '/(index|default)\.(html?|php|aspx?)$', '') || regexp_extract(u, '(\?[^#]+)', 1) AS target, count(*) AS n FROM a WHERE u IS NOT NULL GROUP BY ALL""".replace("\\\\", "\\"))
def page_links(spark, sf_dir):
    return pages.page_links(model.table(spark, sf_dir, "pages"))


@query("refine_types")
def refine_types(spark, sf_dir):
    p = model.table(spark, sf_dir, "pages")
    return pages.refine_types(p.select(F.col("page_id").alias("id"), "url"), pages.page_metadata(p), pages.page_text(p))


@query("replace_partition", "SELECT vec_id AS item_id, label, CASE WHEN label % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM embeddings WHERE NOT (label % 3 = 0 AND vec_id % 2 = 1)")
def replace_partition(spark, sf_dir):
    v = model.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    return curation.replace_partition(v.withColumn("version", F.lit("old")), v.filter("label % 3 = 0 AND item_id % 2 = 0").withColumn("version", F.lit("new")), "label")


@query("set_deleted", f"WITH {model.ITEMS} SELECT id, deleted OR id % 4 = 0 AS deleted FROM items")
def set_deleted(spark, sf_dir):
    items = model.items(spark, sf_dir)
    return curation.set_deleted(items, items.filter("id % 4 = 0")).select("id", "deleted")


@query("purge_vectors", f"WITH {model.ITEMS}, {model.VECTORS}, gone AS (SELECT id FROM items WHERE id % 9 = 0 UNION SELECT id FROM items WHERE parent_id % 9 = 0) SELECT item_id, chunk FROM vectors WHERE item_id NOT IN (SELECT id FROM gone)")
def purge_vectors(spark, sf_dir):
    items = model.items(spark, sf_dir)
    return curation.purge(items, model.edges(spark, sf_dir), model.vectors(spark, sf_dir), items.filter("id % 9 = 0"))[2].select("item_id", "chunk")


@query("embedding_diff", f"WITH {model.VECTORS} SELECT DISTINCT item_id FROM vectors WHERE model = 'm1' OR item_id % 5 = 0")
def embedding_diff(spark, sf_dir):
    v = model.vectors(spark, sf_dir).withColumn("text_hash", F.md5(F.concat_ws(":", "item_id", "chunk")))
    wanted = v.withColumn("text_hash", F.when(F.col("item_id") % 5 == 0, "changed").otherwise(F.col("text_hash"))).withColumn("model", F.lit("m0"))
    return vectors.embedding_diff(v, wanted)


@query("load_embeddings", f"WITH {model.ITEMS}, {model.VECTORS} SELECT item_id, chunk, round(CAST(vector[1] AS DOUBLE) / sqrt(list_sum(list_transform(vector, lambda y: CAST(y AS DOUBLE) * y))), 6) AS first FROM vectors WHERE model = 'm0' AND item_id IN (SELECT id FROM items WHERE NOT deleted)")
def load_embeddings(spark, sf_dir):
    v = vectors.load_embeddings(model.vectors(spark, sf_dir), model.items(spark, sf_dir), "m0")
    return v.select("item_id", "chunk", F.round(F.get("vector", F.lit(0)), 6).alias("first"))


@query("readable_text", f"WITH {model.ITEMS} SELECT id, CASE WHEN id % 3 <> 0 AND length(trim(extracted_text, ' ')) > 0 THEN extracted_text ELSE concat_ws(chr(10) || chr(10), kind, title) END AS text FROM items")
def readable_text(spark, sf_dir):
    text = F.when(F.col("id") % 3 != 0, F.col("extracted_text"))
    return model.items(spark, sf_dir).select("id", views.readable_text(text, F.col("kind"), F.col("title")).alias("text"))


@query("text_functions", rf"""WITH {model.ITEMS}, s AS (SELECT id, captured_s, extracted_text AS t, regexp_replace(extracted_text, '[ \t\r\n\f\v]+', ' ', 'g') AS f FROM items)
SELECT id, CASE WHEN length(t) <= 40 THEN t ELSE regexp_replace(substring(t, 1, 39), '\s+$', '') || '…' END AS cut, CAST(ceil(length(t) / 4.0) AS BIGINT) AS tokens,
  CASE WHEN length(trim(t, ' ')) = 0 THEN false ELSE suffix(trim(t, ' '), '?') OR len(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+')) >= 4 OR coalesce(list_contains(['what','which','where','when','who','whose','whom','how','why','show','find','list','tell','did','do','does','is','are','was','were','can','could','should','would','have','has'], regexp_extract(lower(t), '[\p{{L}}\p{{N}}]+')), false) END AS natural,
  least(id, 500) || ':' || greatest(id, 500) AS pair FROM s""")
def text_functions_query(spark, sf_dir):
    t = F.col("extracted_text")
    return model.items(spark, sf_dir).select("id", text_functions.truncate(t, 40).alias("cut"), text_functions.estimate_tokens(t).cast("long").alias("tokens"), text_functions.is_natural_language(t).alias("natural"), text_functions.pair_key(F.col("id"), F.lit(500).cast("long")).alias("pair"))


@query("name_functions", r"""WITH p AS (SELECT page_id, 'My_file-' || page_id || CASE page_id % 3 WHEN 0 THEN '.tar' WHEN 1 THEN '.PDF' ELSE '' END AS n FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(n, '(.)\.[A-Za-z0-9]{1,8}$', '\1'), '[_\-]+', ' ', 'g')) AS title, false AS shot FROM p""")
def name_functions(spark, sf_dir):
    n = F.concat(F.lit("My_file-"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".tar").when(F.col("page_id") % 3 == 1, ".PDF").otherwise(""))
    return model.table(spark, sf_dir, "pages").select("page_id", text_functions.title_from_filename(n).alias("title"), text_functions.is_screenshot_name(n).alias("shot"))


@query("url_titles", r"SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+.*/([^/]+)/*$', 1), '\.[A-Za-z0-9]{1,5}$', ''), '[_\-]+', ' ', 'g')), ''), regexp_replace(regexp_extract(lower(url), '^https?://([^/?#:]+)', 1), '^www\.', '')) AS title FROM pages")
def url_titles(spark, sf_dir):
    return model.table(spark, sf_dir, "pages").select("page_id", text_functions.title_from_url(F.col("url")).alias("title"))


@query("relative_times", "WITH e AS (SELECT event_id, value * 50 AS age FROM events) SELECT event_id, CASE WHEN age < 45 THEN 'just now' WHEN age < 90 THEN '1 minute ago' WHEN age < 2700 THEN CAST(CAST(floor(age / 60 + 0.5) AS BIGINT) AS VARCHAR) || ' minutes ago' WHEN age < 5400 THEN '1 hour ago' WHEN age < 79200 THEN CAST(CAST(floor(age / 3600 + 0.5) AS BIGINT) AS VARCHAR) || ' hours ago' WHEN age < 129600 THEN 'yesterday' ELSE CAST(CAST(floor(age / 86400 + 0.5) AS BIGINT) AS VARCHAR) || ' days ago' END AS age FROM e")
def relative_times(spark, sf_dir):
    e = model.table(spark, sf_dir, "events")
    return e.select("event_id", text_functions.relative_time(F.lit(0.0) - F.col("value") * 50, F.lit(0.0)).alias("age"))


@query("duplicate_captures", f"""WITH {model.ITEMS}, l AS (SELECT id, captured_s, coalesce(extracted_text, '') AS t FROM items WHERE NOT deleted),
f AS (SELECT t, arg_min(id, (captured_s, id)) AS duplicate_of, max(captured_s) AS last_kept_s FROM l GROUP BY t)
SELECT id, duplicate_of, last_kept_s FROM l JOIN f USING (t) WHERE id <> duplicate_of""")
def duplicate_captures(spark, sf_dir):
    return preparation.duplicate_captures(model.items(spark, sf_dir).withColumnRenamed("extracted_text", "text"))


@query("run_usage", """SELECT conv_id AS run_id, role AS task, count(*) AS calls, CAST(sum(CASE WHEN role = 'user' THEN ceil(length(text) / 4) ELSE 0 END) AS BIGINT) AS prompt, CAST(sum(CASE WHEN role = 'user' THEN 0 ELSE ceil(length(text) / 4) END) AS BIGINT) AS completion,
CAST(sum(length(text)) AS BIGINT) AS latency_ms, quantile_cont(CAST(length(text) AS DOUBLE), 0.5) AS p50_ms, quantile_cont(CAST(length(text) AS DOUBLE), 0.9) AS p90_ms FROM conversations GROUP BY conv_id, role""")
def run_usage(spark, sf_dir):
    """Turns as calls: what users say is prompt, the rest completion; a turn takes a millisecond a character."""
    c = model.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("role").alias("task"), "text")
    tokens, asked = estimate_tokens(F.col("text")), F.coalesce(F.col("task") == "user", F.lit(False))
    calls = c.select("run_id", "task", F.when(asked, tokens).otherwise(0).alias("prompt"), F.when(asked, 0).otherwise(tokens).alias("completion"), F.length("text").cast("long").alias("latency_ms"))
    return analytics.run_usage(calls)


@query("markdown_docs")
def markdown_docs(spark, sf_dir):
    """Title, plain text and sizes of every document read as markdown."""
    return preparation.markdown_docs(model.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))

"""Registered queries of listings, reports, lifecycle and linking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.operators import analytics, lifecycle, linking, views
from corpuskit.plans import model
from corpuskit.plans.catalog import query

STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in analytics.KEYWORD_STOPWORDS)
MEMBERS = "members AS (SELECT label AS collection_id, vec_id AS item_id FROM embeddings)"


def _members(spark, sf_dir):
    return model.table(spark, sf_dir, "embeddings").select(F.col("label").alias("collection_id"), F.col("vec_id").alias("item_id"))


@query("list_items", f"WITH {model.ITEMS} SELECT id, type, title FROM items WHERE NOT deleted AND parent_id IS NULL AND type IN ('url', 'pdf') ORDER BY lower(title), captured_s DESC, id LIMIT 50 OFFSET 20")
def list_items(spark, sf_dir):
    return views.list_items(model.items(spark, sf_dir), types=["url", "pdf"], sort="title", limit=50, offset=20).select("id", "type", "title")


@query("siblings", f"WITH {model.ITEMS} SELECT id, batch_id, captured_s FROM items WHERE NOT deleted")
def siblings(spark, sf_dir):
    items = model.items(spark, sf_dir)
    return views.siblings(items, items.select("batch_id")).select("id", "batch_id", "captured_s")


@query("summaries", f"""WITH {model.ITEMS}, k AS (SELECT parent_id, id, row_number() OVER (PARTITION BY parent_id ORDER BY captured_s, title, id) AS pos FROM items WHERE NOT deleted AND parent_id IS NOT NULL)
SELECT i.id, i.title, coalesce(n, 0) AS n_children, first_children FROM items i LEFT JOIN (SELECT parent_id, count(*) AS n, array_to_string(list(id ORDER BY pos) FILTER (pos <= 4), ',') AS first_children FROM k GROUP BY parent_id) c ON c.parent_id = i.id WHERE NOT i.deleted AND i.parent_id IS NULL""")
def summaries(spark, sf_dir):
    return views.summaries(model.items(spark, sf_dir)).withColumn("first_children", F.array_join("first_children", ","))


@query("cards", rf"""WITH {model.ITEMS}, f AS (SELECT *, trim(regexp_replace(coalesce(extracted_text, ''), '[ \t\r\n]+', ' ', 'g')) AS flat FROM items WHERE NOT deleted)
SELECT id, type, kind, title, CASE WHEN length(flat) <= 400 THEN flat ELSE rtrim(substring(flat, 1, 399)) || '…' END AS excerpt, length(coalesce(extracted_text, '')) AS chars FROM f""")
def cards(spark, sf_dir):
    return views.cards(model.items(spark, sf_dir))


BUDGET = "r AS (SELECT id // 20 AS request_id, id AS pos, id, length(coalesce(extracted_text, '')) AS chars FROM items WHERE NOT deleted)"


@query("budget_cards", f"WITH {model.ITEMS}, {BUDGET}, s AS (SELECT *, CAST(sum(ceil(chars / 4.0)) OVER w AS BIGINT) AS used, row_number() OVER w AS nth FROM r WINDOW w AS (PARTITION BY request_id ORDER BY pos)) SELECT request_id, id, used FROM s WHERE used <= 4000 OR nth = 1")
def budget_cards(spark, sf_dir):
    rows = model.items(spark, sf_dir).filter("NOT deleted").select(F.floor(F.col("id") / 20).alias("request_id"), F.col("id").alias("pos"), "id", F.length(F.coalesce("extracted_text", F.lit(""))).alias("chars"))
    return views.budget_cards(rows, 4000).select("request_id", "id", "used")


@query("read_slices", f"WITH {model.ITEMS} SELECT id + 1000000 AS request_id, id, substring(extracted_text, 101, 200) AS slice, length(extracted_text) AS total, 300 < length(extracted_text) AS has_more FROM items WHERE NOT deleted")
def read_slices(spark, sf_dir):
    items = model.items(spark, sf_dir)
    return views.read_slices(items, items.select((F.col("id") + 1000000).alias("request_id"), "id", F.lit(100).alias("offset"), F.lit(200).alias("size")))


@query("recent_items", f"WITH {model.ITEMS} SELECT id, captured_s FROM items WHERE NOT deleted AND captured_s >= {model.NOW - 86400 * 20} AND type IN ('text', 'markdown') ORDER BY captured_s DESC, id LIMIT 40")
def recent_items(spark, sf_dir):
    return views.recent_items(model.items(spark, sf_dir), model.NOW - 86400 * 20, ["text", "markdown"], 40).select("id", "captured_s")


CUES = "cues AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'type' ELSE 'kind' END AS field, CASE item_id % 4 WHEN 0 THEN 'url' WHEN 1 THEN 'paper' WHEN 2 THEN 'pdf' ELSE 'docs' END AS value FROM benchmark UNION ALL SELECT item_id, 'kind', 'article' FROM benchmark WHERE item_id % 3 = 0)"


@query("cue_leg", f"WITH {model.ITEMS}, {CUES}, h AS (SELECT DISTINCT query_id, id, captured_s FROM cues c JOIN items i ON NOT deleted AND parent_id IS NULL AND CASE field WHEN 'type' THEN type ELSE kind END = value) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY captured_s DESC, id) AS pos FROM h QUALIFY pos <= 20")
def cue_leg(spark, sf_dir):
    b = model.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    q = F.col("query_id")
    first = b.select("query_id", F.when(q % 2 == 0, "type").otherwise("kind").alias("field"), F.element_at(F.array(*map(F.lit, ("url", "paper", "pdf", "docs"))), (q % 4 + 1).cast("int")).alias("value"))
    cues = first.unionByName(b.filter("query_id % 3 = 0").select("query_id", F.lit("kind").alias("field"), F.lit("article").alias("value")))
    return views.cue_leg(model.items(spark, sf_dir), cues)


@query("group_hits", f"""WITH {model.ITEMS}, h AS (SELECT doc_id // 40 AS query_id, doc_id AS id, row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id * 7919 % 1000, doc_id) AS pos FROM documents),
g AS (SELECT query_id, h.id, pos, CASE type WHEN 'url' THEN 'links' WHEN 'image' THEN 'media' WHEN 'note' THEN 'notes' ELSE 'documents' END AS "group" FROM h JOIN items i ON i.id = h.id),
b AS (SELECT *, min(pos) OVER (PARTITION BY query_id, "group") AS best FROM g) SELECT query_id, id, "group", dense_rank() OVER (PARTITION BY query_id ORDER BY best) AS group_no, pos FROM b""")
def group_hits(spark, sf_dir):
    from pyspark.sql import Window

    d = F.col("doc_id")
    hits = model.table(spark, sf_dir, "documents").select(F.floor(d / 40).alias("query_id"), d.alias("id")).withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("id") * 7919 % 1000, "id")))
    return views.group_hits(hits, model.items(spark, sf_dir))


@query("library_stats", f"WITH {model.ITEMS}, {model.EDGES}, {MEMBERS} SELECT (SELECT count(*) FROM items WHERE NOT deleted) AS n_items, (SELECT count(*) FROM items WHERE NOT deleted AND parent_id IS NULL) AS n_top, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(DISTINCT collection_id) FROM members) AS n_collections")
def library_stats(spark, sf_dir):
    return analytics.stats(model.items(spark, sf_dir), model.edges(spark, sf_dir), _members(spark, sf_dir))


@query("counts_by", f"WITH {model.ITEMS} SELECT type, domain, count(*) AS n FROM items WHERE NOT deleted GROUP BY ALL")
def counts_by(spark, sf_dir):
    return analytics.counts_by(model.items(spark, sf_dir), "type", "domain")


@query("collection_summaries", f"""WITH {model.ITEMS}, {MEMBERS}, l AS (SELECT collection_id, item_id, row_number() OVER (PARTITION BY collection_id ORDER BY captured_s DESC, item_id) AS pos FROM members m JOIN items i ON i.id = m.item_id AND NOT deleted)
SELECT c.collection_id, coalesce(n, 0) AS n, covers FROM (SELECT DISTINCT collection_id FROM members) c LEFT JOIN (SELECT collection_id, count(*) AS n, array_to_string(list(item_id ORDER BY pos) FILTER (pos <= 4), ',') AS covers FROM l GROUP BY 1) s ON s.collection_id = c.collection_id""")
def collection_summaries(spark, sf_dir):
    return analytics.collection_summaries(_members(spark, sf_dir), model.items(spark, sf_dir)).withColumn("covers", F.array_join("covers", ","))


TOPICS = r"t AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS topic FROM items)"


@query("topic_overview", f"WITH {model.ITEMS}, {TOPICS}, c AS (SELECT topic, count(*) AS n FROM t GROUP BY topic ORDER BY n DESC, topic LIMIT 15) SELECT c.topic, c.n, array_to_string((list(t.id ORDER BY t.id))[1:3], ',') AS examples FROM c JOIN t ON t.topic = c.topic GROUP BY c.topic, c.n")
def topic_overview(spark, sf_dir):
    topics = model.items(spark, sf_dir).select("id", F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("topic"))
    return analytics.topic_overview(topics).withColumn("examples", F.array_join("examples", ","))


@query("keywords", rf"""WITH w AS (SELECT id, i, regexp_replace(w[i], '^[.\-]+|[.\-]+$', '', 'g') AS word FROM (SELECT doc_id AS id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z0-9+#.\-]+') AS w FROM documents))),
c AS (SELECT id, word, count(*) AS n, min(i) AS first_at FROM w WHERE length(word) >= 3 AND word NOT IN ({STOP}) AND NOT regexp_full_match(word, '\d+') GROUP BY ALL)
SELECT id, word, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, first_at) AS pos FROM c QUALIFY pos <= 6""")
def keywords(spark, sf_dir):
    return analytics.keywords(model.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("entities", rf"""WITH n AS (SELECT id, w[i] AS name, i FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id AS id, regexp_extract_all(text, '\b([A-Z][A-Za-z0-9]+(?:[ -][A-Z][A-Za-z0-9]+)*)\b', 1) AS w FROM documents WHERE lang = 'en'))),
c AS (SELECT id, name, min(i) AS first_at FROM n WHERE length(name) >= 3 AND lower(name) NOT IN ({STOP}) GROUP BY ALL)
SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY first_at) AS pos FROM c QUALIFY pos <= 8""")
def entities(spark, sf_dir):
    return analytics.entities(model.table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"), "text"))


@query("entities_full")
def entities_full(spark, sf_dir):
    """The names in documents of every language and of none; DuckDB's word boundaries are others beyond ASCII."""
    return analytics.entities(model.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


STEPS = "steps AS (SELECT conv_id AS run_id, turn AS step, CASE role WHEN 'user' THEN 'look' WHEN 'assistant' THEN 'read' ELSE 'write' END AS kind, (conv_id * 31 + turn * 7) % 50 AS item_id, length(text) AS chars FROM conversations)"


def _steps(spark, sf_dir):
    c = model.table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("step"), F.when(F.col("role") == "user", "look").when(F.col("role") == "assistant", "read").otherwise("write").alias("kind"), ((F.col("conv_id") * 31 + F.col("turn") * 7) % 50).alias("item_id"), F.length("text").alias("chars"))


@query("run_evidence", f"WITH {STEPS} SELECT run_id, count(DISTINCT item_id) AS looked, count(DISTINCT CASE WHEN kind = 'read' THEN item_id END) AS read, count(*) FILTER (kind = 'write') AS writes FROM steps GROUP BY run_id")
def run_evidence(spark, sf_dir):
    return analytics.run_evidence(_steps(spark, sf_dir))


@query("run_items", f"WITH {STEPS}, f AS (SELECT run_id, item_id, min(step) AS step FROM steps GROUP BY ALL) SELECT run_id, item_id, row_number() OVER (PARTITION BY run_id ORDER BY step, item_id) AS nth FROM f")
def run_items(spark, sf_dir):
    return analytics.run_items(_steps(spark, sf_dir))


@query("usage_totals", f"WITH {STEPS} SELECT run_id, count(*) AS calls, CAST(sum(chars) AS BIGINT) AS chars, median(chars) AS p50 FROM steps GROUP BY run_id")
def usage_totals(spark, sf_dir):
    return analytics.usage_totals(_steps(spark, sf_dir))


@query("member_overlap", "WITH m AS (SELECT DISTINCT event_type AS collection_id, user_id AS item_id FROM events) SELECT a.collection_id AS a, b.collection_id AS b, count(*) AS shared, count(*) / any_value(n) AS ratio FROM m a JOIN m b ON a.item_id = b.item_id AND a.collection_id <> b.collection_id JOIN (SELECT collection_id, count(*) AS n FROM m GROUP BY 1) s ON s.collection_id = a.collection_id GROUP BY 1, 2")
def member_overlap(spark, sf_dir):
    return analytics.member_overlap(model.table(spark, sf_dir, "events").select(F.col("event_type").alias("collection_id"), F.col("user_id").alias("item_id")))


LATEST = "latest AS (SELECT item_id, stage, arg_max(outcome, (at_us, seq)) AS outcome, max(at_us) AS at_us FROM stage_events GROUP BY item_id, stage)"


@query("latest_stage", f"WITH {model.STAGE_EVENTS}, {LATEST} SELECT * FROM latest")
def latest_stage(spark, sf_dir):
    return lifecycle.latest_stage(model.stage_events(spark, sf_dir))


@query("pending_stages", f"""WITH {model.STAGE_EVENTS}, d AS (SELECT DISTINCT item_id, stage FROM stage_events WHERE outcome = 'failed'),
g(stage, need) AS (VALUES ('embed','extract'),('understand','extract'),('index','embed'),('index','understand'),('relate','index'))
SELECT d.item_id, g.stage FROM d JOIN g ON g.need = d.stage GROUP BY d.item_id, g.stage HAVING count(*) = (SELECT count(*) FROM g g2 WHERE g2.stage = g.stage) AND NOT EXISTS (SELECT 1 FROM d x WHERE x.item_id = d.item_id AND x.stage = g.stage)""")
def pending_stages(spark, sf_dir):
    return lifecycle.pending_stages(model.stage_events(spark, sf_dir).filter("outcome = 'failed'"))


@query("pending_stages_full", f"""WITH {model.STAGE_EVENTS}, d AS (SELECT DISTINCT item_id, stage FROM stage_events),
g(stage, need) AS (VALUES ('embed','extract'),('understand','extract'),('index','embed'),('index','understand'),('relate','index'))
SELECT d.item_id, g.stage FROM d JOIN g ON g.need = d.stage GROUP BY d.item_id, g.stage HAVING count(*) = (SELECT count(*) FROM g g2 WHERE g2.stage = g.stage) AND NOT EXISTS (SELECT 1 FROM d x WHERE x.item_id = d.item_id AND x.stage = g.stage)""")
def pending_stages_full(spark, sf_dir):
    """Over results of every outcome."""
    return lifecycle.pending_stages(model.stage_events(spark, sf_dir))


@query("backlog_head", f"WITH {model.STAGE_EVENTS}, l AS (SELECT item_id, stage, arg_max(outcome, (at_us, seq)) AS outcome, max(at_us) AS at_us, arg_max(seq, (at_us, seq)) AS seq FROM stage_events GROUP BY item_id, stage) SELECT stage, item_id, at_us FROM l WHERE outcome = 'failed' QUALIFY row_number() OVER (PARTITION BY stage ORDER BY at_us, seq) = 1")
def backlog_head(spark, sf_dir):
    return lifecycle.backlog_head(model.stage_events(spark, sf_dir))


@query("batch_ready", f"WITH {model.ITEMS}, {model.STAGE_EVENTS}, x AS (SELECT DISTINCT item_id FROM stage_events WHERE stage = 'index') SELECT batch_id, bool_and(x.item_id IS NOT NULL) AS ready FROM items i LEFT JOIN x ON x.item_id = i.id WHERE NOT deleted AND type <> 'note' GROUP BY batch_id")
def batch_ready(spark, sf_dir):
    return lifecycle.batch_ready(model.items(spark, sf_dir), model.stage_events(spark, sf_dir))


STATUS_FOLD = f"""WITH RECURSIVE {model.STAGE_EVENTS}, o AS (SELECT item_id, stage, outcome, row_number() OVER (PARTITION BY item_id ORDER BY at_us, seq) AS n FROM stage_events),
f AS (SELECT DISTINCT item_id, CAST(0 AS BIGINT) AS n, 'CAPTURED' AS status FROM stage_events UNION ALL
  SELECT o.item_id, o.n, CASE o.stage
    WHEN 'extract' THEN CASE WHEN o.outcome = 'failed' THEN 'EXTRACTION_FAILED' ELSE 'EXTRACTED' END
    WHEN 'embed' THEN CASE WHEN o.outcome <> 'failed' AND f.status IN ('CAPTURED','EXTRACTING','EXTRACTED','EMBEDDING') THEN 'UNDERSTANDING' ELSE f.status END
    WHEN 'understand' THEN CASE WHEN o.outcome = 'failed' THEN 'AI_FAILED' WHEN o.outcome = 'partial' THEN 'PARTIAL' WHEN f.status = 'EXTRACTION_FAILED' THEN 'PARTIAL' ELSE 'RELATING' END
    WHEN 'relate' THEN CASE WHEN o.outcome = 'failed' THEN 'AI_FAILED' WHEN o.outcome = 'partial' OR f.status IN ('EXTRACTION_FAILED','PARTIAL') THEN 'PARTIAL' ELSE 'READY' END
    ELSE f.status END
  FROM f JOIN o ON o.item_id = f.item_id AND o.n = f.n + 1)
SELECT item_id, status, n FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC) = 1"""


@query("status_fold", STATUS_FOLD)
def status_fold(spark, sf_dir):
    return lifecycle.status_fold(model.stage_events(spark, sf_dir))


@query("same_domain", f"WITH {model.ITEMS}, l AS (SELECT id, domain, captured_s FROM items WHERE NOT deleted AND domain IS NOT NULL) SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.captured_s DESC, b.id) AS pos FROM l a JOIN l b ON a.domain = b.domain AND a.id <> b.id QUALIFY pos <= 10")
def same_domain(spark, sf_dir):
    items = model.items(spark, sf_dir)
    return linking.same_group(items, items, "domain", 10)


@query("same_batch", f"WITH {model.ITEMS}, l AS (SELECT id, batch_id, captured_s FROM items WHERE NOT deleted) SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.captured_s DESC, b.id) AS pos FROM l a JOIN l b ON a.batch_id = b.batch_id AND a.id <> b.id QUALIFY pos <= 20")
def same_batch(spark, sf_dir):
    items = model.items(spark, sf_dir)
    return linking.same_group(items, items, "batch_id", 20)


@query("within_window", f"WITH {model.ITEMS}, l AS (SELECT id, captured_s FROM items WHERE NOT deleted AND parent_id IS NULL) SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.captured_s DESC, b.id) AS pos FROM l a JOIN l b ON a.id <> b.id AND abs(a.captured_s - b.captured_s) <= 7200 QUALIFY pos <= 10")
def within_window(spark, sf_dir):
    items = model.items(spark, sf_dir)
    return linking.within_window(items, items, 7200, 10)


@query("edges_of", f"WITH {model.EDGES} SELECT source_id AS id, target_id AS other, type, 'out' AS direction FROM edges UNION ALL SELECT target_id, source_id, type, 'in' FROM edges")
def edges_of(spark, sf_dir):
    asked = model.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return linking.edges_of(model.edges(spark, sf_dir), asked)


@query("edges_between", f"WITH {model.EDGES}, p AS (SELECT DISTINCT least(doc_id, doc_id + 1) AS a, greatest(doc_id, (doc_id * 7 + 3) % (SELECT count(*) FROM documents)) AS b, least(doc_id, (doc_id * 7 + 3) % (SELECT count(*) FROM documents)) AS lo FROM documents) SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, type FROM edges e WHERE EXISTS (SELECT 1 FROM p WHERE p.lo = least(source_id, target_id) AND p.b = greatest(source_id, target_id))")
def edges_between(spark, sf_dir):
    edges = model.edges(spark, sf_dir)
    return linking.edges_between(edges, edges.select(F.col("target_id").alias("x"), F.col("source_id").alias("y")))


@query("drop_suppressed", f"WITH {model.EDGES} SELECT source_id, target_id, type FROM edges WHERE least(source_id, target_id) % 5 <> 0")
def drop_suppressed(spark, sf_dir):
    edges = model.edges(spark, sf_dir)
    gone = edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).filter("a % 5 = 0")
    return linking.drop_suppressed(edges, gone).select("source_id", "target_id", "type")


@query("similar_names", rf"""WITH w AS (SELECT p_partkey AS id, list_distinct(list_filter(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[\p{{L}}\p{{N}}]+'), lambda t: t NOT IN ('the','and','of','for','a','an','to','in','on','my','stuff','things'))) AS w FROM part),
s AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS n, len(a.w) + len(b.w) AS t FROM w a JOIN w b ON a.id < b.id WHERE len(a.w) > 0 AND len(b.w) > 0)
SELECT a, b, n / (t - n) AS similarity FROM s WHERE n / (t - n) >= 0.6""")
def similar_names(spark, sf_dir):
    names = model.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"))
    return linking.similar_names(names, every=True)


@query("check_integrity", f"WITH {model.ITEMS}, {model.EDGES}, l AS (SELECT * FROM items WHERE NOT deleted) SELECT 'orphan' AS rule, id FROM l WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM l) UNION ALL SELECT DISTINCT 'edge_end', e FROM (SELECT source_id AS e FROM edges UNION SELECT target_id FROM edges) WHERE e NOT IN (SELECT id FROM l) UNION ALL SELECT 'type', id FROM l WHERE type NOT IN ('url', 'pdf', 'text', 'markdown', 'image')")
def check_integrity(spark, sf_dir):
    return linking.check_integrity(model.items(spark, sf_dir).filter("NOT deleted"), model.edges(spark, sf_dir), ["url", "pdf", "text", "markdown", "image"])


@query("rank_candidates", f"""WITH {model.ITEMS}, l AS (SELECT id, domain, batch_id, captured_s FROM items WHERE NOT deleted),
s AS (SELECT a.id, b.id AS other, 'domain' AS flag, row_number() OVER (PARTITION BY a.id ORDER BY b.captured_s DESC, b.id) AS pos FROM l a JOIN l b ON a.domain = b.domain AND a.id <> b.id QUALIFY pos <= 10),
t AS (SELECT a.id, b.id AS other, 'batch' AS flag, row_number() OVER (PARTITION BY a.id ORDER BY b.captured_s DESC, b.id) AS pos FROM l a JOIN l b ON a.batch_id = b.batch_id AND a.id <> b.id QUALIFY pos <= 20),
m AS (SELECT id, other, 0.1 AS score, array_to_string(list(DISTINCT flag ORDER BY flag), ',') AS flags FROM (SELECT * FROM s UNION ALL SELECT * FROM t) GROUP BY id, other)
SELECT id, other, CAST(score AS DOUBLE) AS score, flags, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS pos FROM m QUALIFY pos <= 12""")
def rank_candidates(spark, sf_dir):
    items = model.items(spark, sf_dir)
    flagged = lambda df, flag: df.select("id", "other", F.lit(flag).alias("flag"), F.lit(None).cast("double").alias("cosine"))
    signals = flagged(linking.same_group(items, items, "domain", 10), "domain").unionByName(flagged(linking.same_group(items, items, "batch_id", 20), "batch"))
    return linking.rank_candidates(signals, 12)

"""Registered queries of preparation and curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions.text import normalize_name
from corpuskit.operators import curation, fusion, history, lexical, preparation, vectors
from corpuskit.plans import model, search_queries
from corpuskit.plans.catalog import query

_HOSTS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in preparation.HOST_ALIASES.items())
_KEEP = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in preparation.KEEP_PARAMS.items())
_URL = preparation.URL
CANON = rf"""parts AS (SELECT page_id AS id, url, lower(regexp_extract(url, '{_URL}', 2)) AS h, regexp_extract(url, '{_URL}', 4) AS p, substring(regexp_extract(url, '{_URL}', 5), 2) AS q, regexp_extract(url, '{_URL}', 6) AS f FROM pages),
hosts AS (SELECT *, regexp_replace(h, '^(www|m|mobile|amp)\.', '') AS bare FROM parts WHERE h <> ''),
named AS (SELECT *, CASE bare {_HOSTS} ELSE CASE h {_HOSTS} ELSE bare END END AS host, regexp_replace(regexp_replace(regexp_replace(p, '/{{2,}}', '/', 'g'), '/+$', ''), '(?i)/(index|default)\.(html?|php|aspx?)$', '') AS path FROM hosts),
kept AS (SELECT *, CASE host {_KEEP} END AS params, CASE WHEN bare = 'youtu.be' THEN regexp_extract(path, '^/([^/]+)', 1) WHEN host = 'youtube.com' THEN regexp_extract(path, '^/(?:shorts|live|embed)/([A-Za-z0-9_-]+)$', 1) ELSE '' END AS short FROM named),
ps AS (SELECT *, list_transform(list_sort(list_transform(list_filter(string_split(q, '&'), lambda x: x <> '' AND CASE WHEN params IS NOT NULL THEN list_contains(string_split(params, ','), split_part(x, '=', 1)) ELSE NOT regexp_matches(split_part(x, '=', 1), '{preparation.TRACKING}') END), lambda x, i: {{'n': split_part(x, '=', 1), 'i': i, 'p': x}})), lambda x: x.p) AS ps FROM kept),
vs AS (SELECT *, CASE WHEN short <> '' THEN ['v=' || short] WHEN host = 'youtube.com' AND path = '/watch' THEN list_filter(ps, lambda x: split_part(x, '=', 1) = 'v')[1:1] ELSE ps END AS vs FROM ps),
canon AS (SELECT id, url, 'https://' || host || CASE WHEN short <> '' THEN '/watch' ELSE path END || CASE WHEN len(vs) > 0 THEN '?' || array_to_string(vs, '&') ELSE '' END || CASE WHEN regexp_matches(f, '^#[/!]') THEN f ELSE '' END AS canonical FROM vs)"""


def _links(spark, sf_dir):
    return model.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", (F.lit(0) - F.col("page_id") % 5).alias("captured_s"))


@query("canonical_links", f"WITH {CANON} SELECT id, canonical FROM canon")
def canonical_links(spark, sf_dir):
    return _links(spark, sf_dir).select("id", preparation.canonical_url(F.col("url")).alias("canonical")).filter("canonical IS NOT NULL")


@query("dedupe_links", f"WITH {CANON} SELECT canonical, arg_min(id, (-(id % 5), id)) AS id, count(*) AS n FROM canon GROUP BY canonical")
def dedupe_links(spark, sf_dir):
    return preparation.dedupe_links(_links(spark, sf_dir))


@query("type_links", rf"WITH {CANON} SELECT id, CASE WHEN regexp_matches(canonical, '^https://[^?#]*\.pdf($|[?#])') THEN 'pdf' ELSE 'generic' END AS kind, CASE WHEN regexp_matches(canonical, '^https://[^?#]*\.pdf($|[?#])') THEN regexp_extract(canonical, '^(https://[^?#]*\.pdf)', 1) ELSE regexp_extract(canonical, '^https://([^/?#]+)', 1) END AS key FROM canon")
def type_links(spark, sf_dir):
    return preparation.type_links(_links(spark, sf_dir))


@query("dedupe_content", "SELECT sha256(coalesce(text, '')) AS hash, arg_min(doc_id, (doc_id % 97, doc_id)) AS id, count(*) AS n, max(doc_id % 97) AS last_kept_s FROM documents GROUP BY 1")
def dedupe_content(spark, sf_dir):
    return preparation.dedupe_content(model.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 97).alias("captured_s")))


@query("chunk_bodies")
def chunk_bodies(spark, sf_dir):
    return preparation.chunk_bodies(model.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), max_chunks=None)


@query("profile_text", r"""WITH f AS (SELECT doc_id AS id, text, trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g')) AS flat FROM documents)
SELECT id, CASE WHEN length(flat) <= 280 THEN flat ELSE rtrim(substring(flat, 1, 279)) || '…' END AS excerpt, length(coalesce(text, '')) > 60000 AS truncated, CASE WHEN flat = '' THEN 0 ELSE len(string_split(flat, ' ')) END AS n_words FROM f""")
def profile_text(spark, sf_dir):
    return preparation.profile_text(model.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("annotate_kind", rf"""WITH {model.ITEMS}, t AS (SELECT id, type, lower(domain) AS domain, lower(title) AS title, lower(title || chr(10) || coalesce(extracted_text, '')) AS text FROM items)
SELECT id, CASE {" ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{label}'" for label, c, p in preparation.KIND_RULES)} ELSE 'other' END AS guessed FROM t""")
def annotate_kind(spark, sf_dir):
    return preparation.annotate_kind(model.items(spark, sf_dir))


@query("clean_confidence", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN (doc_id % 100) / 100.0::DOUBLE WHEN 1 THEN (doc_id % 100) / 100.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE CASE WHEN doc_id % 100 <= 1 THEN (doc_id % 100)::DOUBLE ELSE 0.5::DOUBLE END END AS confidence FROM documents")
def clean_confidence(spark, sf_dir):
    d = F.col("doc_id")
    raw = F.when(d % 4 == 0, F.concat((d % 100).cast("string"), F.lit(" %"))).when(d % 4 == 1, (d % 100 / 100.0).cast("string")).when(d % 4 == 2, "x").otherwise((d % 100).cast("string"))
    return model.table(spark, sf_dir, "documents").select("doc_id", preparation.clean_confidence(raw).alias("confidence"))


@query("markdown_headings", r"""WITH l AS (SELECT doc_id AS id, unnest(range(1, len(t) + 1)) AS i, t FROM (SELECT doc_id, string_split('# ' || replace(text, chr(10), chr(10) || '## '), chr(10)) AS t FROM documents)),
h AS (SELECT id, i, t[i] AS t FROM l WHERE regexp_matches(t[i], '^#{1,6}\s+\S'))
SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS pos, length(regexp_extract(t, '^(#+)', 1)) AS level, regexp_replace(regexp_replace(t, '^#+\s+', ''), '\s*#*\s*$', '') AS heading FROM h QUALIFY pos <= 40""")
def markdown_headings(spark, sf_dir):
    """Every line of a document as a heading."""
    text = F.concat(F.lit("# "), F.regexp_replace("text", "\n", "\n## "))
    return preparation.markdown_headings(model.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.alias("text")))


PROPOSED = f"{model.EDGES}, n AS (SELECT count(*) AS n FROM documents), p0 AS (SELECT concat_ws('-', source_id, target_id, type) AS proposal_id, (source_id + CASE WHEN source_id % 3 = 0 THEN 0 ELSE 1 END) % n AS s, target_id AS t, type FROM edges, n)"


@query("add_edges", f"""WITH {model.ITEMS}, {PROPOSED}, p AS (SELECT proposal_id, CASE WHEN sym AND s > t THEN t ELSE s END AS source_id, CASE WHEN sym AND s > t THEN s ELSE t END AS target_id, type FROM (SELECT *, type IN ('related_to','same_project','alternative_to','contradicts','duplicate_of') AS sym FROM p0)),
live AS (SELECT id FROM items WHERE NOT deleted)
SELECT proposal_id, source_id, target_id, type, CASE WHEN source_id = target_id THEN 'self' WHEN source_id NOT IN (SELECT id FROM live) OR target_id NOT IN (SELECT id FROM live) THEN 'missing'
  WHEN EXISTS (SELECT 1 FROM edges e WHERE e.source_id = p.source_id AND e.target_id = p.target_id AND e.type = p.type) THEN 'exists' WHEN least(source_id, target_id) % 5 = 0 THEN 'suppressed'
  WHEN row_number() OVER (PARTITION BY source_id, target_id, type ORDER BY proposal_id) > 1 THEN 'repeated' END AS reason FROM p""")
def add_edges(spark, sf_dir):
    edges, docs = model.edges(spark, sf_dir), model.table(spark, sf_dir, "documents")
    n = docs.agg(F.count("*").alias("n"))
    numbered = edges.withColumn("proposal_id", F.concat_ws("-", "source_id", "target_id", "type"))
    proposals = numbered.crossJoin(F.broadcast(n)).withColumn("source_id", (F.col("source_id") + F.when(F.col("source_id") % 3 == 0, 0).otherwise(1)) % F.col("n")).drop("n", "confidence")
    d = docs.select("doc_id").filter("doc_id % 5 = 0").select(F.col("doc_id").alias("a"))
    pairs = proposals.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).join(d, "a")
    return curation.add_edges(edges, proposals, model.items(spark, sf_dir), pairs)


@query("validate_members", f"""WITH {model.ITEMS}, m AS (SELECT CAST(label AS BIGINT) AS collection_id, vec_id AS item_id FROM embeddings), p AS (SELECT doc_id % 12 AS collection_id, doc_id AS item_id, (doc_id % 100) / 100.0 AS confidence FROM documents)
SELECT collection_id, item_id, CASE WHEN collection_id NOT IN (SELECT collection_id FROM m) OR item_id NOT IN (SELECT id FROM items WHERE NOT deleted) THEN 'missing' WHEN confidence < 0.7 THEN 'confidence'
  WHEN EXISTS (SELECT 1 FROM m WHERE m.collection_id = p.collection_id AND m.item_id = p.item_id) THEN 'exists' WHEN item_id % 13 = 0 THEN 'suppressed' END AS reason FROM p""")
def validate_members(spark, sf_dir):
    members = model.table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("collection_id"), F.col("vec_id").alias("item_id"))
    plan = model.table(spark, sf_dir, "documents").select((F.col("doc_id") % 12).alias("collection_id"), F.col("doc_id").alias("item_id"), (F.col("doc_id") % 100 / 100.0).alias("confidence"))
    return curation.validate_members(plan, members, model.items(spark, sf_dir), plan.filter("item_id % 13 = 0"))


AUDIT = "audit AS (SELECT event_id AS seq, user_id AS entity_id, event_type AS field, CAST(round(value, 4) AS DOUBLE) AS value, epoch_us(ts) AS at_us, value > 180 AS undone FROM events)"


def _audit(spark, sf_dir):
    return model.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("field"), F.round("value", 4).alias("value"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), (F.col("value") > 180).alias("undone"))


@query("audit_view", f"WITH {AUDIT} SELECT seq, entity_id, field, at_us FROM audit WHERE entity_id = 7 ORDER BY at_us DESC, seq DESC LIMIT 50")
def audit_view(spark, sf_dir):
    return curation.audit_view(_audit(spark, sf_dir), 7).select("seq", "entity_id", "field", "at_us")


@query("fold_audit", f"WITH {AUDIT} SELECT entity_id, field, arg_max(value, (at_us, seq)) AS value FROM audit WHERE NOT undone GROUP BY entity_id, field")
def fold_audit(spark, sf_dir):
    return curation.fold_audit(_audit(spark, sf_dir))


@query("undo", f"""WITH {AUDIT}, l AS (SELECT *, seq % 6 = 0 AS asked FROM audit WHERE NOT undone)
SELECT seq, entity_id, field, (SELECT arg_max(b.value, (b.at_us, b.seq)) FROM l b WHERE b.entity_id = a.entity_id AND b.field = a.field AND NOT b.asked AND (b.at_us, b.seq) < (a.at_us, a.seq)) AS value,
  EXISTS (SELECT 1 FROM l c WHERE c.entity_id = a.entity_id AND c.field = a.field AND NOT c.asked AND (c.at_us, c.seq) > (a.at_us, a.seq)) AS conflict FROM l a WHERE asked""")
def undo(spark, sf_dir):
    audit = _audit(spark, sf_dir)
    return curation.undo(audit, audit.filter("seq % 6 = 0"))


@query("upsert_vectors", "SELECT vec_id AS item_id, CASE WHEN vec_id % 4 = 0 THEN 'm2' ELSE 'm1' END AS model FROM embeddings")
def upsert_vectors(spark, sf_dir):
    v = model.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"))
    return curation.upsert(v.withColumn("model", F.lit("m1")), v.filter("item_id % 4 = 0").withColumn("model", F.lit("m2")), ["item_id"])


@query("purge", f"WITH {model.ITEMS}, {model.EDGES}, gone AS (SELECT id FROM items WHERE id % 9 = 0 UNION SELECT id FROM items WHERE parent_id % 9 = 0) SELECT source_id, target_id, type FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)")
def purge(spark, sf_dir):
    items = model.items(spark, sf_dir)
    _, edges, _ = curation.purge(items, model.edges(spark, sf_dir), model.vectors(spark, sf_dir), items.filter("id % 9 = 0"))
    return edges.select("source_id", "target_id", "type")


HASHED = search_queries.HASH
QUERY_VECTORS = HASHED.replace("FROM items", "FROM (SELECT item_id AS id, text AS title FROM benchmark)").replace("words AS", "q_words AS").replace("FROM words", "FROM q_words").replace("terms AS", "q_terms AS").replace("FROM terms", "FROM q_terms").replace("hashed AS", "q_hashed AS").replace("FROM hashed", "FROM q_hashed").replace("cells AS", "q_cells AS").replace("FROM cells", "FROM q_cells").replace("unit AS", "q_unit AS")
HYBRID = f"""WITH {search_queries.INDEX}, {model.QUERY_TOKENS}, {search_queries.LEX}, {HASHED}, {QUERY_VECTORS},
vec AS (SELECT q.id AS query_id, u.id, round(sum(q.x * u.x), 9) AS cosine FROM q_unit q JOIN unit u ON u.bucket = q.bucket JOIN items i ON i.id = u.id AND NOT i.deleted GROUP BY q.id, u.id),
vpos AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS pos FROM vec QUALIFY pos <= 40),
tokens AS (SELECT query_id, list(DISTINCT term) AS tokens, count(DISTINCT term) AS n FROM q_tokens GROUP BY query_id),
legs AS (SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.id, v.id) AS id, l.pos AS l_pos, CASE WHEN l.pos IS NOT NULL OR v.cosine >= 0.2 THEN v.pos END AS v_pos FROM lex l FULL OUTER JOIN vpos v ON v.query_id = l.query_id AND v.id = l.id),
s AS (SELECT g.query_id, g.id, i.captured_s, i.parent_id, round((coalesce(1.0::DOUBLE / (60 + l_pos), 0) + coalesce(CASE WHEN n <= 2 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END / (60 + v_pos), 0))
  * CASE WHEN len(list_filter(t.tokens, lambda x: NOT list_contains(regexp_extract_all(lower(i.title), '[\\p{{L}}\\p{{N}}]+'), x))) = 0 THEN 1.3::DOUBLE WHEN list_contains(t.tokens, split_part(lower(i.domain), '.', 1)) THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END
  * (1 + 0.25 * exp(-greatest(0.0::DOUBLE, ({model.NOW} - i.captured_s) / 86400.0::DOUBLE) / 60)), 9) AS score
  FROM legs g JOIN tokens t ON t.query_id = g.query_id JOIN items i ON i.id = g.id AND NOT i.deleted AND i.type <> 'note' WHERE l_pos IS NOT NULL OR v_pos IS NOT NULL),
c AS (SELECT * FROM s QUALIFY parent_id IS NULL OR row_number() OVER (PARTITION BY query_id, coalesce(parent_id, -id - 1) ORDER BY score DESC, captured_s DESC, id) <= 3)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, captured_s DESC, id) AS pos, round(score, 6) AS score FROM c QUALIFY pos <= 10"""


@query("hybrid_search", HYBRID)
def hybrid_search(spark, sf_dir):
    """Each benchmark text as a query, its words for the lexical leg and as a hashed vector, against titles."""
    items = model.items(spark, sf_dir)
    idx = search_queries.stored(spark, sf_dir)
    q = model.queries(spark, sf_dir)
    lex = lexical.lexical_search(idx, q, synonyms=False)
    live = items.filter("NOT deleted").select("id", F.col("title").alias("text"))
    v = vectors.hash_embed(live).select(F.col("id").alias("item_id"), F.lit(0).alias("chunk"), F.lit("summary").alias("role"), "vector")
    qv = vectors.hash_embed(model.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")).select(F.col("id").alias("query_id"), "vector")
    hits = vectors.knn(v, qv, 40).filter("cosine <> 0")
    return fusion.fuse(lex, hits, items, q, model.NOW, floor=0.2).select("query_id", "id", "pos", F.round("score", 6).alias("score"))


def embedded(items):
    """``item_id, chunk, role, vector``: hashed vectors of each item's title (chunk 0, its summary) and of every chunk of
    its whole text."""
    summary = items.select("id", F.lit(0).alias("chunk"), F.col("title").alias("text"))
    bodies = preparation.chunk_bodies(items.select("id", F.col("extracted_text").alias("text")), max_chunks=None).withColumn("chunk", F.col("chunk") + 1)
    hashed = vectors.hash_embed(summary.unionByName(bodies).select(F.struct("id", "chunk").alias("id"), "text"))
    return hashed.select(F.col("id.id").alias("item_id"), F.col("id.chunk").alias("chunk"), F.when(F.col("id.chunk") == 0, "summary").otherwise("body").alias("role"), "vector")


@query("hash_embed_full")
def hash_embed_full(spark, sf_dir):
    """The vectors of titles and whole texts; beyond what DuckDB does in time."""
    cells = embedded(model.items(spark, sf_dir)).select(F.col("item_id").alias("id"), "chunk", "role", F.posexplode("vector").alias("bucket", "x"))
    return cells.filter("x <> 0").withColumn("bucket", F.col("bucket").cast("long")).withColumn("x", F.round("x", 6))


@query("hybrid_search_full")
def hybrid_search_full(spark, sf_dir):
    """Each benchmark text as a query, all its words in both legs, against the titles and every chunk of the texts; the
    best chunk of an item counts. Beyond what DuckDB does in time."""
    items = model.items(spark, sf_dir)
    idx = search_queries.stored(spark, sf_dir)
    asked = model.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    q = asked.select("query_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("tokens"))
    lex = lexical.lexical_search(idx, q, synonyms=False)
    qv = vectors.hash_embed(asked.withColumnRenamed("query_id", "id")).select(F.col("id").alias("query_id"), "vector")
    hits = vectors.knn(embedded(items.filter("NOT deleted")), qv, 40).filter("cosine <> 0")
    return fusion.fuse(lex, hits, items, q, model.NOW, floor=0.2).select("query_id", "id", "pos", F.round("score", 6).alias("score"))


def _history(spark, sf_dir):
    """The event log as an audit log: what runs (users) did to links, members and items."""
    e, v = model.table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.col("event_type")
    action = F.when(kind == "signup", "add_member").when(kind == "view", "create_link").when(kind == "click", "remove_link").when(kind == "purchase", "update_item").otherwise("remove_member")
    return e.select(
        v.alias("seq"), F.col("user_id").cast("long").alias("run_id"), F.when(F.col("value") > 50, "agent").otherwise("user").alias("actor"), action.alias("action"), (v % 5).alias("collection_id"), (v % 23).alias("item_id"), (v * 7 % 23 + 23).alias("other_id"),
        F.lit("related_to").alias("name"), F.concat(F.lit("was "), v.cast("string")).alias("before"), F.concat(F.lit("f"), (v % 3).cast("string")).alias("field"), F.lit(None).cast("array<bigint>").alias("ids"), (F.col("value") > 180).alias("undone"),
    )


@query("undo_runs", """WITH h AS (SELECT event_id AS seq, user_id AS run_id, CASE WHEN value > 50 THEN 'agent' ELSE 'user' END AS actor, CASE event_type WHEN 'signup' THEN 'add_member' WHEN 'view' THEN 'create_link' WHEN 'click' THEN 'remove_link' WHEN 'purchase' THEN 'update_item' ELSE 'remove_member' END AS action,
  event_id % 5 AS collection_id, event_id % 23 AS item_id, event_id * 7 % 23 + 23 AS other_id, 'was ' || event_id AS before, 'f' || event_id % 3 AS field FROM events WHERE NOT value > 180 AND user_id % 3 = 0),
ok AS (SELECT *, NOT ((action = 'remove_member' AND (collection_id >= 4 OR item_id >= 20)) OR (action = 'remove_link' AND (item_id >= 20 OR other_id >= 40)) OR (action = 'update_item' AND item_id >= 20)) AS good FROM h),
m AS (SELECT collection_id AS a, item_id AS b, arg_min(action, seq) = 'remove_member' AS present FROM ok WHERE good AND action LIKE '%member' GROUP BY ALL),
ms AS (SELECT collection_id AS a, item_id AS b, arg_min(action, seq) = 'add_member' AS present FROM ok WHERE good AND (action = 'remove_member' OR (action = 'add_member' AND actor = 'agent')) GROUP BY ALL),
ns AS (SELECT item_id AS b, 'c' || collection_id AS value, arg_min(action, seq) = 'add_member' AS present FROM ok WHERE good AND collection_id < 4 AND (action = 'remove_member' OR (action = 'add_member' AND actor = 'agent')) GROUP BY ALL),
l AS (SELECT item_id AS a, other_id AS b, arg_min(action, seq) = 'remove_link' AS present FROM ok WHERE good AND action LIKE '%link' GROUP BY ALL),
ls AS (SELECT item_id AS a, other_id AS b, arg_min(action, seq) = 'create_link' AS present FROM ok WHERE good AND (action = 'remove_link' OR (action = 'create_link' AND actor = 'agent')) GROUP BY ALL),
i AS (SELECT item_id AS a, field AS text, arg_min(before, seq) AS value FROM ok WHERE good AND action = 'update_item' GROUP BY ALL)
SELECT 'entry' AS kind, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::VARCHAR AS text, CASE WHEN NOT good THEN 'gone' END AS value, NULL::BOOLEAN AS present, seq FROM ok
UNION ALL SELECT 'member', a, b, NULL, NULL, present, NULL FROM m UNION ALL SELECT 'suppression', a, b, 'member', NULL, present, NULL FROM ms
UNION ALL SELECT 'suppression', NULL, b, 'name', value, present, NULL FROM ns UNION ALL SELECT 'link', a, b, 'related_to', NULL, present, NULL FROM l
UNION ALL SELECT 'suppression', a, b, 'link', NULL, present, NULL FROM ls UNION ALL SELECT 'item', a, NULL, text, value, NULL, NULL FROM i""")
def undo_runs(spark, sf_dir):
    """All runs of every third user undone: links, members and fields as they were, what an agent did suppressed."""
    log = _history(spark, sf_dir)
    ids = lambda n, name: spark.range(n).select(F.col("id").alias(name))
    collections = ids(4, "collection_id").withColumn("name", F.concat(F.lit("C"), F.col("collection_id").cast("string")))
    items = ids(40, "id").filter("id < 20 OR id >= 23")
    members = ids(4, "collection_id").crossJoin(ids(20, "item_id")).filter("(collection_id + item_id) % 2 = 0")  # eighty rows
    links = items.select(F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"), F.lit("related_to").alias("type"))
    runs = log.filter("run_id % 3 = 0").select("run_id")
    return history.undo_entries(log, history.of_runs(log, runs), collections, members, items, links)


@query("near_duplicates", rf"""WITH {model.ITEMS}, {model.VECTORS}, live AS (SELECT id, type, domain, trim(regexp_replace(regexp_replace(lower(title), '[\p{{P}}\p{{S}}]+', ' ', 'g'), '\s+', ' ', 'g')) AS k FROM items WHERE NOT deleted),
t AS (SELECT min(id) OVER (PARTITION BY k, domain, type) AS a, id AS b FROM live WHERE k <> ''),
u AS (SELECT l.id, l.type, list_transform(v.vector, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(v.vector, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM vectors v JOIN live l ON l.id = v.item_id WHERE v.role = 'summary')
SELECT a, b FROM t WHERE a <> b UNION SELECT x.id, y.id FROM u x JOIN u y ON x.type = y.type AND x.id < y.id AND round(list_dot_product(x.v, y.v), 9) >= 0.3""")
def near_duplicates(spark, sf_dir):
    """By title or by vector; the vectors of the test tables have few pairs as near as the default, so less is asked, and
    of all pairs."""
    return vectors.near_duplicates(model.items(spark, sf_dir), normalize_name(F.col("title")), model.vectors(spark, sf_dir), 0.3, "exact")

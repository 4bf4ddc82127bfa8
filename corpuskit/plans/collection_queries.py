"""Registered queries of collections, candidates, runs and the newer search operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions.text import normalize_name, tokenize
from corpuskit.operators import collections, fusion, index, lexical, linking, records, vectors, views
from corpuskit.operators import queries as understanding
from corpuskit.plans import curation_queries, model, record_queries, search_queries
from corpuskit.plans.catalog import query
from corpuskit.sources import tables

TOKENS = r"[\p{{L}}\p{{N}}]+"


def collection_rows(spark, sf_dir):
    """``collection_id, name, description, created_by``: one collection for each source and language."""
    d = model.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("s"), F.coalesce("lang", F.lit("xx")).alias("l"))
    rows = d.groupBy("s", "l").agg(F.min("doc_id").alias("collection_id"), F.count("*").alias("n"))
    return rows.select("collection_id", F.concat_ws(" ", F.lit("Texts from"), "s", "l").alias("name"), F.concat_ws(" ", "s", "l").alias("description"), F.when(F.col("collection_id") % 3 == 0, "user").otherwise("agent").alias("created_by"), "s", "l")


def member_rows(spark, sf_dir):
    d = model.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.coalesce("source", F.lit("none")).alias("s"), F.coalesce("lang", F.lit("xx")).alias("l"))
    return d.join(collection_rows(spark, sf_dir).select("s", "l", "collection_id"), ["s", "l"]).select("collection_id", "item_id")


COLLECTIONS = """colls AS (SELECT min(doc_id) AS collection_id, concat_ws(' ', 'Texts from', s, l) AS name, CASE WHEN min(doc_id) % 3 = 0 THEN 'user' ELSE 'agent' END AS created_by, s, l
  FROM (SELECT doc_id, coalesce(source, 'none') AS s, coalesce(lang, 'xx') AS l FROM documents) GROUP BY s, l),
mem AS (SELECT c.collection_id, d.doc_id AS item_id FROM documents d JOIN colls c ON c.s = coalesce(d.source, 'none') AND c.l = coalesce(d.lang, 'xx'))"""


@query("children", f"WITH {model.ITEMS} SELECT id, parent_id FROM items WHERE NOT deleted AND parent_id IS NOT NULL")
def children(spark, sf_dir):
    items = model.items(spark, sf_dir)
    return views.children(items, items.select("id")).select("id", "parent_id")


@query("same_owner", f"WITH {model.ITEMS}, {record_queries.METADATA}, l AS (SELECT i.id, m.metadata->>'$.repo.owner' AS o, captured_s FROM items i JOIN meta m ON m.id = i.id WHERE NOT deleted) SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.captured_s DESC, b.id) AS pos FROM l a JOIN l b ON a.o = b.o AND a.id <> b.id QUALIFY pos <= 10")
def same_owner(spark, sf_dir):
    items = model.items(spark, sf_dir).join(record_queries.metadata(spark, sf_dir), "id")
    return linking.same_owner(items, items)


MADE = "CASE WHEN source_id % 4 = 0 THEN 'user' ELSE 'agent' END"


def _made(spark, sf_dir):
    return model.edges(spark, sf_dir).withColumn("created_by", F.when(F.col("source_id") % 4 == 0, "user").otherwise("agent"))


@query("linked_candidates", f"WITH {model.EDGES}, e AS (SELECT *, {MADE} AS made FROM edges) SELECT DISTINCT id, other, CASE made WHEN 'user' THEN 'user_related' ELSE 'already_related' END AS flag FROM (SELECT source_id AS id, target_id AS other, made FROM e UNION ALL SELECT target_id, source_id, made FROM e) WHERE id <> other")
def linked_candidates(spark, sf_dir):
    return linking.linked_candidates(_made(spark, sf_dir), model.items(spark, sf_dir))


def _signals(spark, sf_dir):
    items = model.items(spark, sf_dir)
    none, no = F.lit(None).cast("double").alias("cosine"), F.lit(False).alias("lexical")
    batch = linking.same_group(items, items, "batch_id", 20).select("id", "other", F.lit("same_batch").alias("flag"), none, no)
    linked = linking.linked_candidates(_made(spark, sf_dir), items).select("id", "other", "flag", none, no)
    v = model.vectors(spark, sf_dir).filter("role = 'summary'")
    near = vectors.knn(v, v.select(F.col("item_id").alias("query_id"), "vector"), 10, True, 0.3, True)
    close = near.select(F.col("query_id").alias("id"), F.col("item_id").alias("other"), F.lit(None).cast("string").alias("flag"), F.round("cosine", 6).alias("cosine"), no)
    bag = lexical.bag_candidates(search_queries.stored(spark, sf_dir), items.filter("NOT deleted").select("id", F.col("title").alias("text")))
    titled = bag.select("id", "other", F.lit(None).cast("string").alias("flag"), none, F.lit(True).alias("lexical"))
    return batch.unionByName(linked).unionByName(close).unionByName(titled)


BAG = f"""bag AS (SELECT id AS query_id, unnest((list_filter(w, lambda t, i: length(t) >= 2 AND list_position(w, t) = i))[1:24]) AS term FROM (SELECT id, regexp_extract_all(lower(title), '{TOKENS.format()}') AS w FROM items WHERE NOT deleted)),
bagged AS (SELECT query_id AS id, id AS other, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9), id) AS pos FROM (SELECT b.query_id, g.id, -sum(gain) AS rank FROM bag b JOIN gain g ON g.term = b.term WHERE b.query_id <> g.id GROUP BY ALL) QUALIFY pos <= 10)"""
CANDIDATES = f"""{search_queries.INDEX}, {BAG}, {model.EDGES}, {model.VECTORS}, {search_queries.KNN.replace('AND q.item_id % 20 = 0', 'AND c.role = q.role AND c.item_id <> q.item_id')},
e AS (SELECT *, {MADE} AS made FROM edges), live AS (SELECT * FROM items WHERE NOT deleted),
sig AS (SELECT a.id, b.id AS other, 'same_batch' AS flag, CAST(NULL AS DOUBLE) AS cosine, false AS lexical FROM live a JOIN live b ON a.batch_id = b.batch_id AND a.id <> b.id
  UNION ALL SELECT id, other, CASE made WHEN 'user' THEN 'user_related' ELSE 'already_related' END, NULL, false FROM (SELECT source_id AS id, target_id AS other, made FROM e UNION ALL SELECT target_id, source_id, made FROM e) WHERE id <> other
  UNION ALL SELECT query_id, item_id, NULL, round(cosine, 6), false FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS p FROM knn WHERE cosine >= 0.3) WHERE p <= 10
  UNION ALL SELECT id, other, NULL, NULL, true FROM bagged),
m AS (SELECT id, other, max(cosine) AS cosine, list_sort(list(DISTINCT flag) FILTER (flag IS NOT NULL)) AS flags, bool_or(lexical) AS lexical FROM sig GROUP BY id, other),
r AS (SELECT m.id, m.other, m.cosine, coalesce(m.flags, []) AS flags, CASE WHEN a.lang = b.lang THEN 1 ELSE 0 END AS n_topics, CASE WHEN lower(a.kind) = lower(b.kind) THEN 1 ELSE 0 END AS n_entities, lexical FROM m JOIN items a ON a.id = m.id JOIN live b ON b.id = m.other),
cand AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS pos FROM (SELECT *, round(coalesce(cosine, 0.0) + CASE WHEN lexical THEN 0.15 ELSE 0.0 END + 0.1 * n_entities + 0.05 * n_topics + CASE WHEN len(flags) > 0 THEN 0.1 ELSE 0.0 END, 9) AS score FROM (SELECT id, other, cosine, flags, lexical, CAST(n_entities AS DOUBLE) AS n_entities, CAST(n_topics AS DOUBLE) AS n_topics FROM r)) QUALIFY pos <= 18)"""


def _candidates(spark, sf_dir):
    items = model.items(spark, sf_dir)
    told = items.select("id", F.filter(F.array("lang"), lambda x: x.isNotNull()).alias("topics"), F.array(F.upper("kind")).alias("entities"), "deleted")
    return linking.candidates(_signals(spark, sf_dir), told)


@query("candidates", f"WITH {CANDIDATES} SELECT id, other, round(score, 6) AS score, array_to_string(flags, ',') AS flags, pos FROM cand")
def candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("id", "other", F.round("score", 6).alias("score"), F.array_join("flags", ",").alias("flags"), "pos")


@query("propose_links", f"""WITH {CANDIDATES}, f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos, other) AS nth FROM cand WHERE coalesce(cosine, 0) >= 0.35)
SELECT id AS source_id, other AS target_id, CASE WHEN n_entities > 0 AND cosine >= 0.4 THEN 'same_project' ELSE 'related_to' END AS type, CASE WHEN round(cosine, 2) > 0.9 THEN 0.9 WHEN round(cosine, 2) < 0.6 THEN 0.6 ELSE round(cosine, 2) END::DOUBLE AS confidence FROM f WHERE nth <= 3""")
def propose_links(spark, sf_dir):
    """The thresholds fit these vectors, whose closest pairs are near 0.5."""
    contexts = model.vectors(spark, sf_dir).select("item_id", "collection_id", F.lit(0.0).alias("cosine"))
    return collections.propose_links(_candidates(spark, sf_dir), contexts, near=0.35, project=0.4)[0]


def _plan(spark, sf_dir):
    d = F.col("doc_id")
    rows = model.table(spark, sf_dir, "documents").select((d % 97).alias("plan_id"), d.alias("proposal_id"), (d - d % 3).alias("source_id"), (d * 7 % 211).alias("target_id"), (d * 37 % 100 / 100.0).alias("confidence"))
    return rows.unionByName(rows.select("plan_id", (F.col("proposal_id") + 1_000_000_000).alias("proposal_id"), F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit(0.95).alias("confidence")))


@query("validate_edges")
def validate_edges(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    subjects = plan.filter("source_id % 2 = 0").select("plan_id", F.col("source_id").alias("id"))
    seen = plan.filter("target_id % 5 <> 0").select("plan_id", F.col("target_id").alias("id"))
    off = plan.filter("proposal_id % 11 = 0").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"))
    return collections.validate_edges(plan, subjects, seen, model.edges(spark, sf_dir), off)


@query("validate_collections")
def validate_collections(spark, sf_dir):
    """Every document's title proposed as a collection of its neighbours, fifty a plan."""
    items = model.items(spark, sf_dir)
    plan = items.select(F.col("id").alias("proposal_id"), F.when(F.col("id") % 7 == 0, "Tools").when(F.col("id") % 7 == 1, F.concat_ws(" ", F.lit("texts of"), "domain")).otherwise(F.col("title")).alias("name"), F.substring("extracted_text", 1, 60).alias("description"), (F.col("id") % 10 / 10.0).alias("confidence"), F.floor(F.col("id") / 50).alias("plan_id"))
    proposed = items.select(F.col("id").alias("proposal_id"), F.explode(F.array("id", F.col("id") + 1, F.col("id") + 2)).alias("item_id"))
    off = plan.filter("proposal_id % 4 = 0").select(normalize_name(F.col("name")).alias("name_key"), F.col("proposal_id").alias("item_id"))
    return collections.validate_collections(plan, proposed, collection_rows(spark, sf_dir), items, off)


@query("validate_names", f"""WITH {COLLECTIONS}, r AS (SELECT d.doc_id AS request_id, CASE WHEN doc_id % 2 = 0 THEN c.collection_id END AS collection_id, CASE WHEN doc_id % 5 = 0 THEN 'user' ELSE 'agent' END AS actor,
  CASE doc_id % 6 WHEN 0 THEN c.name WHEN 1 THEN '  ' WHEN 2 THEN 'Name  ' || doc_id WHEN 3 THEN repeat('long ', 20) WHEN 4 THEN lower(c.name) ELSE 'Name ' || doc_id END AS name, c.created_by FROM documents d JOIN mem m ON m.item_id = d.doc_id JOIN colls c ON c.collection_id = m.collection_id),
n AS (SELECT *, regexp_replace(trim(name), '\\s+', ' ', 'g') AS nm FROM r), k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(nm), '[\\p{{P}}\\p{{S}}]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM n)
SELECT request_id, CASE WHEN actor = 'agent' AND collection_id IS NOT NULL AND created_by = 'user' THEN 'named by a person' WHEN key = '' THEN 'empty' WHEN length(nm) > 80 THEN 'too long'
  WHEN EXISTS (SELECT 1 FROM colls c WHERE lower(c.name) = key AND c.collection_id IS DISTINCT FROM k.collection_id) THEN 'taken' END AS reason FROM k""")
def validate_names(spark, sf_dir):
    c = collection_rows(spark, sf_dir)
    d = member_rows(spark, sf_dir).join(c.select("collection_id", "name"), "collection_id")
    i = F.col("item_id")
    name = F.when(i % 6 == 0, F.col("name")).when(i % 6 == 1, "  ").when(i % 6 == 2, F.concat(F.lit("Name  "), i.cast("string"))).when(i % 6 == 3, F.repeat(F.lit("long "), 20)).when(i % 6 == 4, F.lower("name")).otherwise(F.concat(F.lit("Name "), i.cast("string")))
    requests = d.select(i.alias("request_id"), F.when(i % 2 == 0, F.col("collection_id")).alias("collection_id"), name.alias("name"), F.when(i % 5 == 0, "user").otherwise("agent").alias("actor"))
    return collections.validate_names(requests, c).select("request_id", "reason")


@query("merge_collections", f"""WITH {COLLECTIONS}, pl AS (SELECT a.collection_id AS source, b.collection_id AS into_id, a.s AS s1, b.s AS s2, a.l AS l1, b.l AS l2 FROM colls a JOIN colls b ON a.l = b.l AND a.collection_id > b.collection_id AND a.created_by = 'agent' AND b.created_by = 'agent'),
w AS (SELECT source, into_id, list_distinct(['texts', 'from'] || regexp_extract_all(lower(s1 || ' ' || l1), '{TOKENS.format()}')) AS a, list_distinct(['texts', 'from'] || regexp_extract_all(lower(s2 || ' ' || l2), '{TOKENS.format()}')) AS b FROM pl),
g0 AS (SELECT source, min(into_id) AS into_id FROM w WHERE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) >= 0.5 GROUP BY source), g AS (SELECT * FROM g0 WHERE source NOT IN (SELECT into_id FROM g0))
SELECT coalesce(g.into_id, m.collection_id) AS collection_id, m.item_id FROM mem m LEFT JOIN g ON g.source = m.collection_id""")
def merge_collections(spark, sf_dir):
    """Collections of one language, each later one into an earlier one."""
    c = collection_rows(spark, sf_dir)
    plan = c.select("l", F.col("collection_id").alias("source")).join(c.select("l", F.col("collection_id").alias("into")), "l").filter("source > into").select("source", "into")
    return collections.merge_collections(c, member_rows(spark, sf_dir), plan)[1]


@query("sweep_items", f"""WITH {model.ITEMS}, {COLLECTIONS}, live AS (SELECT * FROM items WHERE NOT deleted AND type <> 'note'),
a AS (SELECT id, 0 AS rank, captured_s FROM live WHERE batch_id % 50 = 3 UNION ALL SELECT id, 1, captured_s FROM live WHERE id IN (SELECT item_id FROM mem JOIN colls USING (collection_id) WHERE created_by = 'agent' AND l = 'xx')
 UNION ALL SELECT * FROM (SELECT id, 2, captured_s FROM live WHERE parent_id IS NULL ORDER BY captured_s DESC, id LIMIT 40)), o AS (SELECT id, min(rank) AS rank, max(captured_s) AS c FROM a GROUP BY id)
SELECT id, rank, row_number() OVER (ORDER BY rank, c DESC, id) AS pos FROM o QUALIFY pos <= 120""")
def sweep_items(spark, sf_dir):
    items = model.items(spark, sf_dir)
    return collections.sweep_items(items, items.filter("batch_id % 50 = 3"), collection_rows(spark, sf_dir).filter("l = 'xx'"), member_rows(spark, sf_dir))


@query("collection_context", f"""WITH {model.VECTORS}, {COLLECTIONS}, c AS (SELECT item_id, mem.collection_id, round(CAST(vector[1] AS DOUBLE), 4) AS cosine FROM vectors v JOIN mem USING (item_id) WHERE role = 'summary'),
s AS (SELECT item_id % 10 AS request_id, item_id, row_number() OVER (PARTITION BY item_id % 10 ORDER BY item_id) AS p FROM vectors WHERE role = 'summary'), n AS (SELECT request_id, collection_id, max(cosine) AS cosine FROM s JOIN c USING (item_id) WHERE p <= 8 GROUP BY ALL)
SELECT q.request_id, colls.collection_id, n.cosine, row_number() OVER (PARTITION BY q.request_id ORDER BY n.cosine DESC NULLS LAST, name, colls.collection_id) AS pos FROM (SELECT DISTINCT request_id FROM s) q CROSS JOIN colls LEFT JOIN n ON n.request_id = q.request_id AND n.collection_id = colls.collection_id QUALIFY pos <= 30""")
def collection_context(spark, sf_dir):
    from pyspark.sql import Window

    v = model.vectors(spark, sf_dir).filter("role = 'summary'")
    near = v.select("item_id", F.round(F.get("vector", F.lit(0)).cast("double"), 4).alias("cosine")).join(member_rows(spark, sf_dir), "item_id")
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("item_id"))
    subjects = v.select((F.col("item_id") % 10).alias("request_id"), "item_id").withColumn("pos", place)
    return collections.collection_context(near, subjects, collection_rows(spark, sf_dir)).select("request_id", "collection_id", "cosine", "pos")


@query("apply_proposals", f"""WITH {model.ITEMS}, p AS (SELECT id, CASE id % 5 WHEN 0 THEN 'tag' WHEN 1 THEN 'rename' WHEN 2 THEN 'trash' WHEN 3 THEN 'add' ELSE 'tag' END AS kind FROM items)
SELECT i.id, CASE WHEN p.kind = 'rename' AND NOT deleted AND i.id % 2 = 0 THEN 'Renamed ' || i.id ELSE title END AS title, CASE WHEN p.kind = 'tag' AND NOT deleted AND i.id % 3 <> 0 THEN concat_ws(',', i.kind, 'new', CASE WHEN i.kind <> 'docs' THEN 'docs' END) ELSE i.kind END AS topics FROM items i JOIN p ON p.id = i.id""")
def apply_proposals(spark, sf_dir):
    items = model.items(spark, sf_dir)
    i = F.col("id")
    held = F.map_from_arrays(F.array(F.lit("title"), F.lit("topics")), F.array(i % 2 == 1, i % 3 == 0))
    rows = items.select("id", "title", F.array("kind").alias("topics"), held.alias("overrides"), "deleted")
    kind = F.when(i % 5 == 1, "rename").when(i % 5 == 2, "trash").when(i % 5 == 3, "add").otherwise("tag")
    proposals = items.select((i + 7).alias("proposal_id"), kind.alias("kind"), i.alias("item_id"), (i % 10).alias("collection_id"), F.array(F.lit("new"), F.lit("NEW"), F.lit("docs")).alias("values"), F.concat(F.lit("Renamed "), i.cast("string")).alias("title"))
    after, _, _ = collections.apply_proposals(proposals, rows)
    return after.select("id", "title", F.array_join("topics", ",").alias("topics"))


@query("unapplied_proposals", f"WITH {model.ITEMS} SELECT id AS proposal_id, kind FROM (SELECT id, deleted, CASE id % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'trash' WHEN 2 THEN 'rename' ELSE 'create' END AS kind FROM items) WHERE kind = 'trash' OR deleted OR (kind = 'rename' AND id % 3 = 0)")
def unapplied_proposals(spark, sf_dir):
    i = F.col("id")
    rows = model.items(spark, sf_dir).select("id", "title", F.array("kind").alias("topics"), F.map_from_arrays(F.array(F.lit("title")), F.array(i % 3 == 0)).alias("overrides"), "deleted")
    kind = F.when(i % 4 == 0, "add").when(i % 4 == 1, "trash").when(i % 4 == 2, "rename").otherwise("create")
    proposals = rows.select(i.alias("proposal_id"), kind.alias("kind"), i.alias("item_id"), i.alias("collection_id"), F.array("title").alias("values"), "title")
    return collections.apply_proposals(proposals, rows)[2]


RUNS = """runs AS (SELECT event_id AS run_id, CASE WHEN event_id % 3 = 0 THEN user_id END AS item_id, CASE WHEN event_id % 3 <> 0 THEN user_id // 4 END AS batch_id, epoch_us(ts) AS started_us FROM events)"""


@query("runs_for", f"""WITH {model.ITEMS}, {RUNS}, h AS (SELECT item_id AS id, run_id, started_us FROM runs WHERE item_id IN (SELECT id FROM items) UNION SELECT i.id, run_id, started_us FROM items i JOIN runs r ON r.batch_id = i.batch_id)
SELECT id, run_id, run_id % 4 <> 0 AND run_id % 10 <> 0 AS undoable, row_number() OVER (PARTITION BY id ORDER BY started_us DESC, run_id) AS pos FROM h QUALIFY pos <= 20""")
def runs_for(spark, sf_dir):
    e, u, n = model.table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id")
    runs = e.select(n.alias("run_id"), F.when(n % 3 == 0, u).alias("item_id"), F.when(n % 3 != 0, F.floor(u / 4)).alias("batch_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("started_us"))
    audit = e.select(F.when(n % 10 != 0, n).alias("run_id"), (n % 4 == 0).alias("undone"))
    items = model.items(spark, sf_dir)
    return collections.runs_for(runs, audit, items, items)


@query("active_progress", f"WITH {model.ITEMS}, {model.STAGE_EVENTS}, l AS (SELECT item_id, stage, arg_max(outcome, (at_us, seq)) AS outcome FROM stage_events GROUP BY item_id, stage) SELECT item_id, stage, outcome, title, NOT deleted AS live FROM l LEFT JOIN items i ON i.id = l.item_id WHERE outcome <> 'ok'")
def active_progress(spark, sf_dir):
    return collections.active_progress(model.stage_events(spark, sf_dir), model.items(spark, sf_dir))


@query("known_facts", f"""WITH {COLLECTIONS}, {model.EDGES}, e AS (SELECT *, {MADE} AS made FROM edges), p AS (SELECT doc_id AS a, doc_id + 3 AS b FROM documents WHERE doc_id % 6 = 0),
f AS (SELECT item_id AS id, 'member' AS fact, collection_id AS other, CAST(NULL AS VARCHAR) AS about FROM mem WHERE item_id % 3 = 0 UNION SELECT id, 'linked', other, type FROM (SELECT source_id AS id, target_id AS other, type FROM e WHERE made = 'user' UNION ALL SELECT target_id, source_id, type FROM e WHERE made = 'user')
 UNION SELECT a, 'never link', b, NULL FROM p UNION SELECT b, 'never link', a, NULL FROM p WHERE b IN (SELECT doc_id FROM documents) UNION SELECT doc_id, 'never add', NULL, 'misc texts' FROM documents WHERE doc_id % 8 = 0)
SELECT id, fact, other, about, row_number() OVER (PARTITION BY id ORDER BY fact, other NULLS FIRST, about NULLS FIRST) AS pos FROM f QUALIFY pos <= 20""")
def known_facts(spark, sf_dir):
    d = model.table(spark, sf_dir, "documents").select("doc_id")
    members = member_rows(spark, sf_dir).withColumn("added_by", F.when(F.col("item_id") % 3 == 0, "user").otherwise("agent"))
    pairs = d.filter("doc_id % 6 = 0").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 3).alias("b"))
    off = d.filter("doc_id % 8 = 0").select(F.lit("misc texts").alias("name_key"), F.col("doc_id").alias("item_id"))
    return collections.known_facts(d.withColumnRenamed("doc_id", "id"), members, _made(spark, sf_dir), pairs, off)


@query("bag_candidates", f"WITH {search_queries.INDEX}, {BAG} SELECT id, other, pos FROM bagged")
def bag_candidates(spark, sf_dir):
    idx = search_queries.stored(spark, sf_dir)
    return lexical.bag_candidates(idx, model.items(spark, sf_dir).filter("NOT deleted").select("id", F.col("title").alias("text")))


@query("similar_live", f"""WITH {search_queries.INDEX}, {BAG}, {model.VECTORS}, {search_queries.KNN.split("knn AS")[0].rstrip().rstrip(",")}, live AS (SELECT id FROM items WHERE NOT deleted),
k AS (SELECT q.item_id AS id, c.item_id AS other, round(list_dot_product(q.v, c.v), 9) AS cosine FROM u q JOIN u c ON q.role = 'summary' AND c.role = 'summary' AND c.item_id <> q.item_id JOIN live a ON a.id = q.item_id JOIN live b ON b.id = c.item_id WHERE q.item_id % 10 = 0)
SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS pos, round(cosine, 6) AS cosine FROM k WHERE cosine >= 0.3 QUALIFY pos <= 10
UNION ALL SELECT id, other, pos, NULL FROM bagged WHERE id % 10 = 0 AND id NOT IN (SELECT item_id FROM vectors WHERE role = 'summary')""")
def similar_live(spark, sf_dir):
    """Items like every tenth live one: by vector, or by the words of its title where it has none."""
    items = model.items(spark, sf_dir)
    ids = items.filter("NOT deleted AND id % 10 = 0")
    bag = lexical.bag_candidates(search_queries.stored(spark, sf_dir), ids.select("id", F.col("title").alias("text")))
    return vectors.similar_items(model.vectors(spark, sf_dir), items, ids, 10, 0.3, bag).withColumn("cosine", F.round("cosine", 6))


@query("index_fields", r"""WITH f AS (SELECT doc_id AS id, unnest([{'field': 'title', 'text': left(text, 40)}, {'field': 'retrieval_hints', 'text': concat_ws(' ', lang, source)}, {'field': 'topics', 'text': coalesce(lang, '')}, {'field': 'entities', 'text': concat_ws(' ', 'Ada', source)}, {'field': 'understanding', 'text': left(text, 200)}, {'field': 'why_useful', 'text': CASE WHEN doc_id % 2 = 0 THEN 'to read again' END}, {'field': 'vision_text', 'text': CASE WHEN doc_id % 6 = 4 THEN 'a picture of ' || lang END},
  {'field': 'meta_text', 'text': concat_ws(' ', 'About ' || lang, 'H one', 'H two', source, 'zig', 'md', 'py')}, {'field': 'extracted_text', 'text': text}, {'field': 'domain', 'text': source || '.example.org'}, {'field': 'kind', 'text': 'paper'}]) AS f FROM documents),
t AS (SELECT id, f.field AS field, unnest(regexp_extract_all(lower(f.text), '[\p{L}\p{N}]+')) AS term FROM f WHERE f.text IS NOT NULL)
SELECT field, term, count(*) AS n, count(DISTINCT id) AS items FROM t GROUP BY ALL""".replace("\\\\", "\\"))
def index_fields(spark, sf_dir):
    """All eleven fields of the index, lists and metadata among them."""
    d, l = F.col("doc_id"), F.col("lang")
    repo = F.struct(F.col("source").alias("owner"), F.array(F.lit("zig"), F.lit(None).cast("string")).alias("topics"))
    folder = F.struct(F.create_map(F.lit("py"), F.lit(3), F.lit("md"), F.lit(1)).alias("extensions"))
    about = F.struct(F.concat(F.lit(" About "), l).alias("description"), F.array(F.lit("H one"), F.lit("H two")).alias("headings"), repo.alias("repo"), folder.alias("folder"), d.alias("stars"))
    items = model.table(spark, sf_dir, "documents").select(
        d.alias("id"), F.substring("text", 1, 40).alias("title"), F.array("lang", "source").alias("retrieval_hints"), F.array("lang").alias("topics"), F.array(F.lit("Ada"), "source").alias("entities"), F.substring("text", 1, 200).alias("understanding"),
        F.when(d % 2 == 0, "to read again").alias("why_useful"), F.when(d % 6 == 4, F.concat(F.lit("a picture of "), l)).alias("vision_text"), records.meta_text(F.to_json(about)).alias("meta_text"), F.col("text").alias("extracted_text"), F.concat("source", F.lit(".example.org")).alias("domain"), F.lit("paper").alias("kind"),
    )
    rows = index.postings_of(index.item_fields(items)).filter("term IS NOT NULL")
    return rows.groupBy("field", "term").agg(F.sum("tf").alias("n"), F.count("*").alias("items"))


@query("snippets", f"""WITH {search_queries.INDEX}, {model.QUERY_TOKENS}, {search_queries.LEX}, q AS (SELECT query_id, list(DISTINCT term) AS terms FROM q_tokens GROUP BY query_id),
p AS (SELECT l.query_id, l.id, terms, regexp_extract_all(extracted_text, '[\\p{{L}}\\p{{N}}]+[^\\p{{L}}\\p{{N}}]*') AS parts FROM lex l JOIN q USING (query_id) JOIN items i ON i.id = l.id),
w AS (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p), m AS (SELECT * FROM w WHERE list_contains(terms, lower(regexp_extract(parts[i], '^[\\p{{L}}\\p{{N}}]+')))),
n AS (SELECT *, count(*) OVER (PARTITION BY query_id, id ORDER BY i RANGE BETWEEN CURRENT ROW AND 13 FOLLOWING) AS n FROM m), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY n DESC, i) = 1)
SELECT query_id, id, CASE WHEN i > 1 THEN '…' ELSE '' END || trim(regexp_replace(array_to_string(list_transform(parts[i:i + 13], lambda x: CASE WHEN list_contains(terms, lower(regexp_extract(x, '^[\\p{{L}}\\p{{N}}]+'))) THEN regexp_replace(x, '^([\\p{{L}}\\p{{N}}]+)', '[[\\1]]') ELSE x END), ''), '\\s+', ' ', 'g')) || CASE WHEN i + 13 < len(parts) THEN '…' ELSE '' END AS snippet FROM b""")
def snippets(spark, sf_dir):
    idx, groups = search_queries.stored(spark, sf_dir, parts=True), lexical.term_groups(model.queries(spark, sf_dir), synonyms=False)
    hits = lexical.search_groups(idx, groups)
    return lexical.snippets(idx, hits, groups).filter("field = 'extracted_text'").select("query_id", "id", "snippet")


def asked(spark, sf_dir):
    """The benchmark's queries with cues: types, kinds, domains, times, some of them strict."""
    n = F.col("query_id")
    some = lambda when, *values: F.when(when, F.array(*map(F.lit, values))).otherwise(F.array().cast("array<string>"))
    times = {"since": F.when(n % 5 == 0, F.lit(1_704_067_200 + 300_000)), "until": F.when(n % 10 == 0, F.lit(1_704_067_200 + 1_500_000))}
    return model.queries(spark, sf_dir).withColumns({"types": some(n % 3 == 0, "pdf", "url"), "kinds": some(n % 3 == 1, "paper"), "domains": some(n % 7 == 0, "example.org"), "strict": n % 2 == 0, "note_cue": n % 4 == 0, **{k: v.cast("long") for k, v in times.items()}})


ASKED = """asked AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN ['pdf', 'url'] ELSE [] END AS types, CASE WHEN item_id % 3 = 1 THEN ['paper'] ELSE [] END AS kinds, item_id % 7 = 0 AS domained, item_id % 2 = 0 AS strict, item_id % 4 = 0 AS note_cue,
 CASE WHEN item_id % 5 = 0 THEN 1704367200 END AS since, CASE WHEN item_id % 10 = 0 THEN 1705567200 END AS until FROM benchmark)"""


@query("apply_filters", f"""WITH {search_queries.INDEX}, {model.QUERY_TOKENS}, {search_queries.LEX}, {ASKED}
SELECT l.query_id, l.id, l.pos FROM lex l JOIN items i ON i.id = l.id AND NOT deleted JOIN asked a ON a.query_id = l.query_id WHERE (NOT domained OR i.domain LIKE '%.example.org') AND (NOT strict OR ((len(types) + len(kinds) = 0 OR list_contains(types, i.type) OR list_contains(kinds, i.kind)) AND (since IS NULL OR (captured_s >= since AND captured_s <= coalesce(until, {model.NOW})))))""")
def apply_filters(spark, sf_dir):
    hits = lexical.lexical_search(search_queries.stored(spark, sf_dir), model.queries(spark, sf_dir), synonyms=False)
    return lexical.apply_filters(hits.select("query_id", "id", "pos"), model.items(spark, sf_dir), asked(spark, sf_dir), model.NOW)


@query("lexical_synonyms", f"""WITH {search_queries.INDEX}, syn AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{x}')" for k, v in lexical.SYNONYMS.items() for x in v)}) t(a, b)), g0 AS (SELECT item_id AS query_id, list_distinct(w) AS u, w FROM (SELECT item_id, regexp_extract_all(lower(text), '{TOKENS.format()}') || ['app', 'repo'] AS w FROM benchmark)),
g1 AS (SELECT query_id, x AS term, x AS grp FROM (SELECT query_id, unnest(u) AS x FROM g0)), g AS (SELECT query_id, term, grp FROM g1 UNION SELECT query_id, b, grp FROM g1 JOIN syn ON syn.a = term)
SELECT g.query_id, gain.id, round(-sum(gain), 6) AS rank, count(DISTINCT grp) AS groups FROM g JOIN gain ON gain.term = g.term GROUP BY ALL""")
def lexical_synonyms(spark, sf_dir):
    """All words of each benchmark text and two with synonyms, ranked by any of them."""
    q = model.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(F.concat(tokenize(F.col("text")), F.array(F.lit("app"), F.lit("repo")))).alias("tokens"))
    return lexical.bm25(search_queries.stored(spark, sf_dir), lexical.term_groups(q)).withColumn("rank", F.round("rank", 6))


@query("long_phrases", f"""WITH {model.ITEMS}, ph AS (SELECT item_id AS query_id, (regexp_extract_all(lower(text), '{TOKENS.format()}'))[1:6] AS t FROM benchmark),
w AS (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT id, regexp_extract_all(lower(extracted_text), '{TOKENS.format()}') AS t FROM items WHERE NOT deleted))
SELECT query_id, id, count(*) AS n FROM w JOIN ph ON w.t[i] = ph.t[1] AND w.t[i:i + len(ph.t) - 1] = ph.t GROUP BY ALL""")
def long_phrases(spark, sf_dir):
    """The first six words of each benchmark text, word after word."""
    phrases = model.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(tokenize(F.col("text")), 1, 6).alias("tokens"))
    found = lexical.phrase_match(search_queries.stored(spark, sf_dir), phrases)
    return found.filter("field = 'extracted_text'").select("query_id", "id", "n")


SEMANTIC = f"""{model.ITEMS}, {model.VECTORS}, {search_queries.KNN}, h AS (SELECT query_id, item_id AS id, pos, cosine FROM knn WHERE pos <= 30 AND cosine >= 0.2),
s AS (SELECT query_id, h.id, i.captured_s, i.parent_id, round(1.0::DOUBLE / (60 + pos) * (1 + 0.25 * exp(-greatest(0.0::DOUBLE, ({model.NOW} - captured_s) / 86400.0::DOUBLE) / 60)), 9) AS score FROM h JOIN items i ON i.id = h.id AND NOT deleted AND type <> 'note'),
c AS (SELECT * FROM s QUALIFY parent_id IS NULL OR row_number() OVER (PARTITION BY query_id, parent_id ORDER BY score DESC, captured_s DESC, id) <= 3)"""


@query("semantic_search", f"WITH {SEMANTIC} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, captured_s DESC, id) AS pos, round(score, 6) AS score FROM c QUALIFY pos <= 10")
def semantic_search(spark, sf_dir):
    v = model.vectors(spark, sf_dir)
    q = v.filter("role = 'summary' AND item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "vector")
    return fusion.semantic_search(v, q, model.items(spark, sf_dir), model.NOW, floor=0.2).select("query_id", "id", "pos", F.round("score", 6).alias("score"))


CUED = f"""WITH {search_queries.INDEX}, {model.QUERY_TOKENS}, {search_queries.LEX}, {ASKED}, live AS (SELECT *, CASE WHEN type = 'note' THEN 1 ELSE 0 END AS note FROM items WHERE NOT deleted),
cl AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY captured_s DESC, id) AS c_pos FROM asked a JOIN live i ON parent_id IS NULL AND (list_contains(types, type) OR list_contains(kinds, kind)) QUALIFY c_pos <= 20),
full_ AS (SELECT query_id FROM lex GROUP BY query_id HAVING count(*) >= 5), legs AS (SELECT coalesce(l.query_id, c.query_id) AS query_id, coalesce(l.id, c.id) AS id, l.pos AS l_pos, c.c_pos FROM lex l FULL OUTER JOIN (SELECT * FROM cl WHERE query_id NOT IN (SELECT query_id FROM full_)) c ON c.query_id = l.query_id AND c.id = l.id),
t AS (SELECT query_id, list(DISTINCT term) AS tokens FROM q_tokens GROUP BY query_id),
x AS (SELECT g.*, i.captured_s, i.parent_id, i.title, i.domain, a.*  EXCLUDE (query_id), tokens, list_contains(types, i.type) OR list_contains(kinds, i.kind) AS cued, len(types) + len(kinds) > 0 AS has_cue,
  CASE WHEN since IS NULL AND until IS NULL THEN NULL WHEN captured_s <= coalesce(until, {model.NOW}) AND captured_s >= since THEN 1.5 ELSE 1 + 0.5 * greatest(0.0::DOUBLE, 1 - CASE WHEN captured_s < since THEN since - captured_s ELSE captured_s - coalesce(until, {model.NOW}) END / greatest(coalesce(until, {model.NOW}) - since, 86400)::DOUBLE) END AS timed
  FROM legs g JOIN live i ON i.id = g.id JOIN asked a ON a.query_id = g.query_id JOIN t ON t.query_id = g.query_id WHERE note = 0 OR note_cue OR list_contains(types, 'note')),
s AS (SELECT query_id, id, captured_s, parent_id, round(CASE WHEN l_pos IS NOT NULL THEN 1.0::DOUBLE / (60 + l_pos) ELSE 0.3::DOUBLE / (60 + c_pos) END
  * CASE WHEN len(list_filter(tokens, lambda y: NOT list_contains(regexp_extract_all(lower(title), '{TOKENS.format()}'), y))) = 0 THEN 1.3::DOUBLE WHEN list_contains(tokens, split_part(lower(domain), '.', 1)) THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN cued THEN 1.35::DOUBLE ELSE 1.0::DOUBLE END * coalesce(timed::DOUBLE, 1 + 0.25 * exp(-greatest(0.0::DOUBLE, ({model.NOW} - captured_s) / 86400.0::DOUBLE) / 60)), 9) AS score FROM x
  WHERE (NOT domained OR domain LIKE '%.example.org') AND (NOT strict OR ((NOT has_cue OR cued) AND (timed IS NULL OR timed >= 1.5)))),
c AS (SELECT * FROM s QUALIFY parent_id IS NULL OR row_number() OVER (PARTITION BY query_id, coalesce(parent_id, -id - 1) ORDER BY score DESC, captured_s DESC, id) <= 3)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, captured_s DESC, id) AS pos, round(score, 6) AS score FROM c QUALIFY pos <= 10"""


@query("fuse_cued", CUED)
def fuse_cued(spark, sf_dir):
    """Fusion with cues, filters, times and strict queries; the vector leg is empty here, as in a library without vectors."""
    items, q = model.items(spark, sf_dir), asked(spark, sf_dir)
    lex = lexical.lexical_search(search_queries.stored(spark, sf_dir), model.queries(spark, sf_dir), synonyms=False)
    cues = q.select("query_id", F.explode(F.concat(F.transform("types", lambda v: F.struct(F.lit("type").alias("field"), v.alias("value"))), F.transform("kinds", lambda v: F.struct(F.lit("kind").alias("field"), v.alias("value"))))).alias("c")).select("query_id", "c.*")
    none = lex.select("query_id", F.col("id").alias("item_id"), "pos", F.lit(0.0).alias("cosine")).filter(F.lit(False))
    return fusion.fuse(lex, none, items, q, model.NOW, cues=views.cue_leg(items, cues)).select("query_id", "id", "pos", F.round("score", 6).alias("score"))


PHRASED = f"""qw AS (SELECT item_id AS n, regexp_extract_all(lower(text), '{TOKENS.format()}') AS w FROM benchmark),
pq AS (SELECT n AS query_id, CASE n % 3 WHEN 0 THEN list_filter(w, lambda x, i: list_position(w, x) = i) WHEN 1 THEN [] ELSE list_filter([w[1], 'repo', left(w[2], 3)], lambda x, i: list_position([w[1], 'repo', left(w[2], 3)], x) = i) END AS tokens,
  CASE n % 3 WHEN 0 THEN [w[1:2], w[3:5]] WHEN 1 THEN [w[2:4]] ELSE [w[3:4]] END AS phrases FROM qw),
pt AS (SELECT query_id, unnest(range(len(tokens))) AS group_no, unnest(tokens) AS token, len(tokens) AS n FROM pq),
pp AS (SELECT query_id, len(tokens) + unnest(range(len(phrases))) AS group_no, unnest(phrases) AS p FROM pq),
syn AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{x}')" for k, v in lexical.SYNONYMS.items() for x in v)}) t(a, b)),
pg AS (SELECT query_id, group_no, token AS term FROM pt UNION SELECT query_id, group_no, b FROM pt JOIN syn ON a = token
  UNION SELECT query_id, group_no, s.term FROM pt JOIN term_stats s ON group_no = n - 1 AND length(token) >= 2 AND starts_with(s.term, token)
  UNION SELECT query_id, group_no, array_to_string(p, ' ') FROM pp),
ft AS ({' UNION ALL '.join(f"SELECT id, '{f}' AS field, regexp_extract_all(lower({f}), '{TOKENS.format()}') AS t FROM items WHERE NOT deleted" for f in search_queries.FIELDS)}),
fi AS (SELECT id, field, t, unnest(range(1, len(t) + 1)) AS i FROM ft),
ph AS (SELECT array_to_string(p, ' ') AS term, id, field, count(*) AS tf FROM (SELECT DISTINCT p FROM pp) JOIN fi ON t[i] = p[1] AND t[i:i + len(p) - 1] = p GROUP BY ALL),
pw AS (SELECT term, id, sum(({search_queries.WEIGHT})::DOUBLE * tf) AS f FROM ph GROUP BY ALL),
pdf AS (SELECT term, count(DISTINCT id) AS df FROM ph GROUP BY term),
pgain AS (SELECT pw.term, pw.id, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n_tokens / avg_tokens)) AS gain
  FROM pw JOIN pdf ON pdf.term = pw.term JOIN doc_stats d ON d.id = pw.id, totals),
found AS (SELECT query_id, id, -sum(gain) AS rank, count(DISTINCT group_no) AS groups FROM pg JOIN (SELECT * FROM gain UNION ALL SELECT * FROM pgain) g ON g.term = pg.term GROUP BY ALL),
wanted AS (SELECT query_id, count(DISTINCT group_no) AS wanted FROM pg GROUP BY query_id),
{search_queries.LEX[search_queries.LEX.index("a0 AS"):]}"""


def phrased(spark, sf_dir):
    """``query_id, tokens, phrases`` of the benchmark texts: all words and two phrases, a phrase alone, or a word, a word
    with synonyms, the beginning of a word, and a phrase."""
    n, w = F.col("item_id"), tokenize(F.col("text"))
    some = F.array(w[0], F.lit("repo"), F.substring(w[1], 1, 3))
    rows = model.table(spark, sf_dir, "benchmark").filter(F.size(w) >= 5)
    tokens = F.when(n % 3 == 0, F.array_distinct(w)).when(n % 3 == 1, F.array().cast("array<string>")).otherwise(F.array_distinct(some))
    phrases = F.when(n % 3 == 0, F.array(F.slice(w, 1, 2), F.slice(w, 3, 3))).when(n % 3 == 1, F.array(F.slice(w, 2, 3))).otherwise(F.array(F.slice(w, 3, 2)))
    return rows.select(n.alias("query_id"), tokens.alias("tokens"), phrases.alias("phrases"))


@query("search_phrases", f"WITH {search_queries.INDEX}, {PHRASED} SELECT query_id, id, pos, round(norm, 6) AS norm, mode FROM lex")
def search_phrases(spark, sf_dir):
    """Words with synonyms, beginnings of words and phrases in one match, ranked together."""
    idx = search_queries.stored(spark, sf_dir)
    groups = tables.written(lexical.match_groups(phrased(spark, sf_dir), prefixes=idx), "groups")
    return lexical.search_groups(idx, groups, postings=lexical.asked_postings(idx, groups)).withColumn("norm", F.round("norm", 6))


@query("phrase_evidence", f"""WITH {search_queries.INDEX}, {PHRASED}, o AS (SELECT * FROM (VALUES ('title', 0), ('extracted_text', 8), ('domain', 9), ('kind', 10)) t(field, no)),
pf AS (SELECT term, id, field FROM postings UNION ALL SELECT term, id, field FROM ph)
SELECT l.query_id, l.id, array_to_string(list_transform(list_sort(list(DISTINCT {{'no': o.no, 'field': f.field}})), lambda x: x.field), ',') AS fields FROM lex l JOIN pg ON pg.query_id = l.query_id JOIN pf f ON f.term = pg.term AND f.id = l.id JOIN o ON o.field = f.field GROUP BY ALL""")
def phrase_evidence(spark, sf_dir):
    """The fields in which the hits of ``search_phrases`` hold a word or a phrase of the query."""
    _, _, hits = word_leg(phrased(spark, sf_dir), search_queries.stored(spark, sf_dir))
    return hits.select("query_id", "id", F.array_join("fields", ",").alias("fields"))


@query("search_cued", CUED.replace(search_queries.LEX, PHRASED).replace(model.QUERY_TOKENS + ", ", "").replace("t AS (SELECT query_id, list(DISTINCT term) AS tokens FROM q_tokens GROUP BY query_id)", "t AS (SELECT query_id, tokens FROM pq)").replace("CASE WHEN len(list_filter(tokens", "CASE WHEN len(tokens) = 0 THEN 1.0::DOUBLE WHEN len(list_filter(tokens"))
def search_cued(spark, sf_dir):
    """Fusion over ``search_phrases``, with types, kinds, times, domains and strict queries."""
    items = model.items(spark, sf_dir)
    q = phrased(spark, sf_dir).join(asked(spark, sf_dir).drop("tokens"), "query_id")
    _, _, lex = word_leg(phrased(spark, sf_dir), search_queries.stored(spark, sf_dir))
    none = lex.select("query_id", F.col("id").alias("item_id"), "pos", F.lit(0.0).alias("cosine")).filter(F.lit(False))
    cues = views.cue_leg(items, cue_rows(q.withColumn("subtypes", F.array().cast("array<string>"))))
    return fusion.fuse(lex, none, items, q, model.NOW, cues=cues).select("query_id", "id", "pos", F.round("score", 6).alias("score"))


@query("search_library")
def search_library(spark, sf_dir):
    """The whole search, from raw queries: understood, matched by words with synonyms, prefixes and phrases and by
    vectors of whole texts, cued, filtered, fused, with snippets."""
    return search(spark, with_subtypes(model.items(spark, sf_dir)), understanding.understand_queries(raw_queries(spark, sf_dir), model.NOW), search_queries.stored(spark, sf_dir, parts=True))


def raw_queries(spark, sf_dir):
    """``query_id, raw``: the whole benchmark texts as questions, some with a phrase, a cue, an operator, a time."""
    n, words = F.col("item_id"), tokenize(F.col("text"))
    some = lambda a, b: F.array_join(F.slice(words, a, b), " ")
    raw = (
        F.when(n % 7 == 0, F.concat(F.array_join(words, " "), F.lit(" pdf")))
        .when(n % 7 == 1, F.concat(F.lit('"'), some(1, 2), F.lit('" repo '), some(4, 2)))
        .when(n % 7 == 2, F.concat(F.lit("type:pdf "), F.array_join(words, " ")))
        .when(n % 7 == 3, F.concat(some(1, 3), F.lit(" app saved last week")))
        .when(n % 7 == 4, F.concat(F.lit('"'), some(2, 3), F.lit('"')))
        .when(n % 7 == 5, F.concat(some(1, 1), F.lit(' "'), some(2, 2), F.lit('" '), F.substring(F.get(words, F.lit(4)), 1, 3)))
        .otherwise(F.array_join(words, " "))
    )
    return model.table(spark, sf_dir, "benchmark").select(n.alias("query_id"), raw.alias("raw"))


def with_subtypes(items):
    return items.withColumn("subtype", F.when(F.col("id") % 12 == 0, "github_repo").when(F.col("id") % 12 == 4, "screenshot"))


def cue_rows(understood):
    """``query_id, field, value`` of what queries ask for."""
    parts = [understood.select("query_id", F.lit(f).alias("field"), F.explode(c).alias("value")) for f, c in (("type", "types"), ("subtype", "subtypes"), ("kind", "kinds"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def word_leg(understood, idx):
    """Groups of terms and phrases, their postings, and ``query_id, id, pos, norm, mode, fields``."""
    groups = tables.written(lexical.match_groups(understood, prefixes=idx), "groups")
    postings = lexical.asked_postings(idx, groups, keep=True)
    hits = tables.written(lexical.search_groups(idx, groups, postings=postings), "words")
    return groups, postings, hits.join(lexical.matched_fields(idx, groups, hits, postings), ["query_id", "id"], "left")


def search(spark, items, understood, idx):
    """``query_id, id, pos, score, reason, snippet`` and the evidence (``bm25_norm, cosine, matched_fields``) of understood
    queries over items and their index. Phrases are part of the match: an item without them can only come in with those
    that match any part. Texts are read for hits that no word or phrase found."""
    understood = tables.written(understood, "understood")
    groups, postings, lex = word_leg(understood, idx)
    texts = understood.select(F.col("query_id").alias("id"), F.col("embed_text").alias("text"))
    qv = vectors.hash_embed(texts).select(F.col("id").alias("query_id"), "vector")
    near = vectors.knn(curation_queries.embedded(items.filter("NOT deleted")), qv, 40).filter("cosine <> 0")
    hits = fusion.fuse(lex, tables.written(near, "vectors"), items, understood, model.NOW, floor=0.2, cues=tables.written(views.cue_leg(items, cue_rows(understood)), "cues"))
    hits = tables.written(hits, "hits")
    lit = lexical.snippets(idx, hits, groups, postings=postings).groupBy("query_id", "id").agg(F.min_by("snippet", F.array_position(F.array(*map(F.lit, search_queries.FIELDS)), F.col("field"))).alias("lit"))
    bare = hits.join(lit, ["query_id", "id"], "left_anti").select("query_id", "id").join(understood.select("query_id", "tokens"), "query_id")
    plain = items.select("id", F.col("extracted_text").alias("t")).join(bare, "id").select("query_id", "id", lexical.fallback_snippet(F.col("t"), F.col("tokens")).alias("plain"))
    out = hits.join(lit, ["query_id", "id"], "left").join(plain, ["query_id", "id"], "left")
    return out.select("query_id", "id", "pos", F.round("score", 6).alias("score"), "reason", F.coalesce("lit", "plain").alias("snippet"), "bm25_norm", "cosine", "matched_fields")


@query("stems")
def stems(spark, sf_dir):
    """Every term of the index with its stem."""
    return lexical.normalize_vocabulary(search_queries.stored(spark, sf_dir).term_stats.select("term"))


@query("write_index", f"WITH {search_queries.INDEX} SELECT p.term, p.id, p.field, p.tf, s.df FROM postings p JOIN term_stats s ON s.term = p.term")
def write_index(spark, sf_dir):
    """The index written by buckets of terms and read back."""
    items = model.items(spark, sf_dir).select("id", *search_queries.FIELDS, "deleted")
    idx = tables.stored_index(index.item_fields(items), "written-index", parts=False)
    return idx.postings.join(idx.term_stats.select("term", "df"), "term").select("term", "id", "field", "tf", "df")

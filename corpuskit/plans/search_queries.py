"""Registered queries of the text index, lexical and vector search, fusion and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.operators import fusion, index, lexical, vectors
from corpuskit.operators import queries as understanding
from corpuskit.plans import model
from corpuskit.plans.catalog import ORACLES, query
from corpuskit.sources import tables

FIELDS = ("title", "extracted_text", "domain", "kind")
_TOKENS = "unnest(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'))"
TOK = "tok AS (" + " UNION ALL ".join(f"SELECT id, '{f}' AS field, {_TOKENS.format(c=f)} AS term FROM items WHERE NOT deleted" for f in FIELDS) + ")"
POSTINGS = "postings AS (SELECT term, id, field, count(*) AS tf FROM tok GROUP BY ALL)"
STATS = """term_stats AS (SELECT term, count(DISTINCT id) AS df FROM postings GROUP BY term),
doc_stats AS (SELECT i.id, coalesce(t.n, 0) AS n_tokens FROM items i LEFT JOIN (SELECT id, count(*) AS n FROM tok GROUP BY id) t ON t.id = i.id WHERE NOT i.deleted),
totals AS (SELECT count(*) AS n_docs, sum(n_tokens) / count(*) AS avg_tokens FROM doc_stats)"""
WEIGHT = "CASE field WHEN 'title' THEN 8.0 WHEN 'extracted_text' THEN 1.0 ELSE 2.0 END"
GAIN = f"""weighted AS (SELECT term, id, sum(({WEIGHT})::DOUBLE * tf) AS f FROM postings GROUP BY term, id),
gain AS (SELECT w.term, w.id, greatest_idf * w.f * 2.2 / (w.f + 1.2 * (0.25 + 0.75 * d.n_tokens / t.avg_tokens)) AS gain
  FROM weighted w JOIN (SELECT term, df, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS greatest_idf FROM term_stats, totals) s ON s.term = w.term
  JOIN doc_stats d ON d.id = w.id, totals t)"""
INDEX = f"{model.ITEMS}, {TOK}, {POSTINGS}, {STATS}, {GAIN}"
LEX = """found AS (SELECT q.query_id, g.id, -sum(g.gain) AS rank, count(DISTINCT q.term) AS groups FROM q_tokens q JOIN gain g ON g.term = q.term GROUP BY q.query_id, g.id),
wanted AS (SELECT query_id, count(DISTINCT term) AS wanted FROM q_tokens GROUP BY query_id),
a0 AS (SELECT f.query_id, f.id, f.rank, row_number() OVER (PARTITION BY f.query_id ORDER BY round(f.rank, 9), f.id) AS pos FROM found f JOIN wanted w ON w.query_id = f.query_id WHERE groups = wanted),
a1 AS (SELECT query_id, id, pos, CASE WHEN min(rank) OVER p < 0 THEN least(1.0, rank / min(rank) OVER p) ELSE 1.0 END AS norm FROM a0 WHERE pos <= 40 WINDOW p AS (PARTITION BY query_id)),
thin AS (SELECT w.query_id FROM wanted w LEFT JOIN (SELECT query_id, count(*) AS n FROM a1 GROUP BY query_id) c ON c.query_id = w.query_id WHERE coalesce(n, 0) < 5 AND wanted >= 2),
o0 AS (SELECT f.*, row_number() OVER (PARTITION BY f.query_id ORDER BY round(f.rank, 9), f.id) AS pos FROM found f WHERE f.query_id IN (SELECT query_id FROM thin)),
o1 AS (SELECT query_id, id, pos, CASE WHEN min(rank) OVER p < 0 THEN least(1.0, rank / min(rank) OVER p) ELSE 1.0 END * 0.6 AS norm FROM o0 WHERE pos <= 40 WINDOW p AS (PARTITION BY query_id)),
lex AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY mode, pos) AS pos, norm, mode FROM (
  SELECT query_id, id, pos, norm, 'and' AS mode FROM a1 UNION ALL
  SELECT o.query_id, o.id, o.pos, o.norm, 'or' FROM o1 o WHERE NOT EXISTS (SELECT 1 FROM a1 WHERE a1.query_id = o.query_id AND a1.id = o.id)))"""


def _fields(spark, sf_dir):
    return index.item_fields(model.items(spark, sf_dir).select("id", *FIELDS, "deleted"))


def stored(spark, sf_dir, parts=False):
    """The index of the items, written once for all searches; with ``parts`` also what snippets need."""
    return tables.shared_index(spark, [f"{sf_dir}/documents.parquet"], lambda: _fields(spark, sf_dir), parts)


_index = stored


@query("index_term_stats", f"WITH {INDEX} SELECT term, df FROM term_stats")
def index_term_stats(spark, sf_dir):
    return _index(spark, sf_dir).term_stats.select("term", "df")


@query("index_postings", f"WITH {INDEX} SELECT term, id, field, tf FROM postings")
def index_postings(spark, sf_dir):
    return _index(spark, sf_dir).postings.select("term", "id", "field", "tf")


CHANGED = model.ITEMS.replace("text AS extracted_text", "CASE WHEN doc_id % 10 = 0 THEN text || ' changed' ELSE text END AS extracted_text")


@query("index_merge", f"WITH {CHANGED}, {TOK}, {POSTINGS}, {STATS} SELECT term, df FROM term_stats")
def index_merge(spark, sf_dir):
    """Every tenth item changes its text; the merged statistics are those of a rebuild."""
    items = model.items(spark, sf_dir).select("id", *FIELDS, "deleted")
    changed = items.filter("id % 10 = 0").withColumn("extracted_text", F.concat("extracted_text", F.lit(" changed")))
    return index.merge_index(index.build_index(index.index_docs(items)), index.index_docs(changed)).term_stats


@query("lexical_search", f"WITH {INDEX}, {model.QUERY_TOKENS}, {LEX} SELECT query_id, id, pos, round(norm, 6) AS norm, mode FROM lex")
def lexical_search(spark, sf_dir):
    hits = lexical.lexical_search(_index(spark, sf_dir), model.queries(spark, sf_dir), synonyms=False)
    return hits.withColumn("norm", F.round("norm", 6))


@query("bm25", f"WITH {INDEX}, {model.QUERY_TOKENS} SELECT q.query_id, g.id, round(-sum(g.gain), 6) AS rank, count(DISTINCT q.term) AS groups FROM q_tokens q JOIN gain g ON g.term = q.term GROUP BY q.query_id, g.id")
def bm25(spark, sf_dir):
    groups = lexical.term_groups(model.queries(spark, sf_dir), synonyms=False)
    return lexical.bm25(_index(spark, sf_dir), groups).withColumn("rank", F.round("rank", 6))


@query(
    "matched_fields",
    f"""WITH {INDEX}, {model.QUERY_TOKENS}, {LEX}, o AS (SELECT * FROM (VALUES ('title', 0), ('extracted_text', 8), ('domain', 9), ('kind', 10)) t(field, no))
SELECT l.query_id, l.id, array_to_string(list_transform(list_sort(list(DISTINCT {{'no': o.no, 'field': p.field}})), lambda x: x.field), ',') AS fields
FROM lex l JOIN q_tokens q ON q.query_id = l.query_id JOIN postings p ON p.term = q.term AND p.id = l.id JOIN o ON o.field = p.field GROUP BY l.query_id, l.id""",
)
def matched_fields(spark, sf_dir):
    idx, q = _index(spark, sf_dir), model.queries(spark, sf_dir)
    hits = lexical.lexical_search(idx, q, synonyms=False)
    found = lexical.matched_fields(idx, lexical.term_groups(q, synonyms=False), hits)
    return found.withColumn("fields", F.array_join("fields", ","))


@query("prefix_terms", f"WITH {INDEX}, {model.QUERY_TOKENS}, r AS (SELECT item_id AS query_id, (regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))[1:2] AS t FROM benchmark), w AS (SELECT query_id, CASE WHEN t[1] = t[2] THEN t[1:1] ELSE t END AS t FROM r) SELECT DISTINCT query_id, len(t) - 1 AS group_no, s.term FROM w JOIN term_stats s ON starts_with(s.term, t[len(t)]) AND length(t[len(t)]) >= 2 UNION SELECT query_id, unnest(range(len(t))), unnest(t) FROM w")
def prefix_terms(spark, sf_dir):
    words = F.array_distinct(F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), 1, 2))
    q = model.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("tokens"))
    return lexical.with_prefixes(lexical.term_groups(q, synonyms=False), _index(spark, sf_dir)).withColumn("group_no", F.col("group_no").cast("long"))


@query("phrase_match", f"""WITH {model.ITEMS}, ph AS (SELECT item_id AS query_id, (regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))[1:2] AS t FROM benchmark),
w AS (SELECT id, field, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT id, 'title' AS field, regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+') AS t FROM items WHERE NOT deleted UNION ALL SELECT id, 'extracted_text', regexp_extract_all(lower(extracted_text), '[\\p{{L}}\\p{{N}}]+') FROM items WHERE NOT deleted))
SELECT query_id, id, field, count(*) AS n FROM w JOIN ph ON w.t[i] = ph.t[1] AND w.t[i + 1] = ph.t[2] GROUP BY ALL""")
def phrase_match(spark, sf_dir):
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), 1, 2)
    phrases = model.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("tokens"))
    return lexical.phrase_match(_index(spark, sf_dir), phrases).filter("field IN ('title', 'extracted_text')")


KNN = """u AS (SELECT item_id, chunk, role, model, collection_id, list_transform(vector, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(vector, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM vectors),
knn AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS pos, score, cosine FROM (
  SELECT q.item_id AS query_id, c.item_id, max(round(list_dot_product(q.v, c.v), 9) * CASE c.role WHEN 'summary' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END) AS score,
    arg_max(round(list_dot_product(q.v, c.v), 9), round(list_dot_product(q.v, c.v), 9) * CASE c.role WHEN 'summary' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END) AS cosine
  FROM u q JOIN u c ON q.role = 'summary' AND q.item_id % 20 = 0 GROUP BY q.item_id, c.item_id))"""


@query("knn", f"WITH {model.VECTORS}, {KNN} SELECT query_id, item_id, pos, round(score, 6) AS score, round(cosine, 6) AS cosine FROM knn WHERE pos <= 10")
def knn(spark, sf_dir):
    v = model.vectors(spark, sf_dir)
    q = v.filter("role = 'summary' AND item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "vector")
    return vectors.knn(v, q, 10).withColumns({c: F.round(c, 6) for c in ("score", "cosine")})


@query("similar_items", f"WITH {model.VECTORS}, {KNN.replace('AND q.item_id % 20 = 0', 'AND c.role = q.role AND c.item_id <> q.item_id')} SELECT query_id, item_id, pos, round(score, 6) AS score, round(cosine, 6) AS cosine FROM knn WHERE pos <= 10 AND cosine >= 0.3")
def similar_items(spark, sf_dir):
    """Item to item on summaries; the floor fits these vectors, whose closest pairs are near 0.5."""
    v = model.vectors(spark, sf_dir)
    q = v.filter("role = 'summary'").select(F.col("item_id").alias("query_id"), "vector")
    return vectors.knn(v, q, 10, summary_only=True, floor=0.3, exclude_self=True).withColumns({c: F.round(c, 6) for c in ("score", "cosine")})


@query("lsh_recall", f"WITH {model.VECTORS} SELECT count(DISTINCT item_id) AS queries, true AS enough FROM vectors WHERE role = 'summary' AND item_id % 20 = 0")
def lsh_recall(spark, sf_dir):
    """The nearest items by buckets of hyperplanes against the exact ones: nine of ten are found, or more."""
    v = model.vectors(spark, sf_dir)
    q = v.filter("role = 'summary' AND item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "vector")
    found = fusion.recall(vectors.knn(v, q, 10, mode="lsh", tables=16), vectors.knn(v, q, 10))
    return found.select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query("centroids", f"""WITH {model.VECTORS}, {KNN}, s AS (SELECT collection_id, i, sum(v[i]) AS x, count(*) AS n FROM u, range(1, 65) r(i) WHERE role = 'summary' GROUP BY collection_id, i)
SELECT collection_id, max(n) AS n, round(sqrt(sum(x * x)), 6) AS length, round(arg_min(x, i) / sqrt(sum(x * x)), 6) AS first FROM s GROUP BY collection_id""")
def centroids(spark, sf_dir):
    v = model.vectors(spark, sf_dir)
    members = v.filter("role = 'summary'").select("collection_id", "item_id")
    c = vectors.centroids(members, v)
    return c.select("collection_id", "n", F.round(vectors.dot(F.col("sum"), F.col("centroid")), 6).alias("length"), F.round(F.get("centroid", F.lit(0)), 6).alias("first"))


@query("collection_candidates", f"""WITH {model.VECTORS}, {KNN}, s AS (SELECT collection_id, i, sum(v[i]) AS x, count(*) AS n FROM u, range(1, 65) r(i) WHERE role = 'summary' GROUP BY collection_id, i),
r AS (SELECT m.item_id, s.collection_id, i, m.v[i] AS v, s.x - CASE WHEN m.collection_id = s.collection_id THEN m.v[i] ELSE 0 END AS x FROM u m, s WHERE m.role = 'summary' AND (m.collection_id <> s.collection_id OR s.n > 1)),
c AS (SELECT item_id, collection_id, round(sum(v * x) / sqrt(sum(x * x)), 6) AS cosine FROM r GROUP BY ALL)
SELECT item_id, collection_id, cosine, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, collection_id) AS pos FROM c QUALIFY pos <= 3""")
def collection_candidates(spark, sf_dir):
    v = model.vectors(spark, sf_dir)
    members = v.filter("role = 'summary'").select("collection_id", "item_id")
    return vectors.collection_candidates(v, members, v.filter("role = 'summary'"), 3).withColumn("cosine", F.round("cosine", 6))


@query("stale_embeddings", f"WITH {model.ITEMS}, {model.VECTORS} SELECT DISTINCT i.id FROM vectors v JOIN items i ON i.id = v.item_id WHERE NOT i.deleted AND (v.model <> 'm0' OR len(v.vector) <> 64)")
def stale_embeddings(spark, sf_dir):
    return vectors.stale_embeddings(model.vectors(spark, sf_dir), model.items(spark, sf_dir), "m0", 64)


HASH = r"""words AS (SELECT id, list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda t: length(t) >= 2 AND NOT list_contains(['a','an','the','and','or','of','to','in','on','at','by','for','with','from','as','is','are','was','were','be','it','this','that','these','those','you','your','we','our','they','their','i','my'], t)) AS w FROM items),
terms AS (SELECT id, term, sum(n) AS n FROM (SELECT id, unnest(w) AS term, 1.0::DOUBLE AS n FROM words UNION ALL SELECT id, w[i] || '_' || w[i + 1], 0.5 FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM words WHERE len(w) > 1)) GROUP BY id, term),
hashed AS (SELECT id, term, n, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(term, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h1,
  list_reduce(list_prepend(2538058380::BIGINT, list_transform(string_split(term, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h2 FROM terms),
cells AS (SELECT id, h1 % 384 AS bucket, sum(CASE WHEN h2 % 2 = 1 THEN 1.0 ELSE -1.0 END * (1 + ln(n))) AS x FROM hashed GROUP BY id, bucket),
unit AS (SELECT id, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM cells)"""


@query("hash_embed", f"WITH {model.ITEMS}, {HASH} SELECT id, bucket, round(x, 6) AS x FROM unit WHERE x <> 0")
def hash_embed(spark, sf_dir):
    texts = model.items(spark, sf_dir).select("id", F.col("title").alias("text"))
    return vectors.hash_embed(texts).select("id", F.posexplode("vector").alias("bucket", "x")).filter("x <> 0").select("id", F.col("bucket").cast("long").alias("bucket"), F.round("x", 6).alias("x"))




@query("evaluate", f"""WITH {INDEX}, {model.QUERY_TOKENS}, {LEX}, j AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, substring(b.text, 1, 40)))
SELECT j.query_id, min(l.pos) AS rank, coalesce(min(l.pos) <= 3, false) AS hit, round(coalesce(1.0 / min(l.pos), 0.0), 6) AS rr FROM j LEFT JOIN lex l ON l.query_id = j.query_id AND l.id = j.id GROUP BY j.query_id""")
def evaluate(spark, sf_dir):
    """Lexical hits against the documents that hold the beginning of the judged text."""
    judged = fusion.holding(model.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), model.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 40).alias("part")))
    hits = lexical.lexical_search(_index(spark, sf_dir), model.queries(spark, sf_dir), synonyms=False)
    return fusion.evaluate(hits, judged).withColumn("rr", F.round("rr", 6))


@query("evaluate_totals", f"""WITH e AS ({ORACLES["evaluate"]}) SELECT count(*) AS queries, count(*) FILTER (WHERE hit) AS hits, round(avg(CAST(hit AS INT)), 6) AS recall, round(avg(rr), 6) AS mrr FROM e""")
def evaluate_totals(spark, sf_dir):
    return fusion.evaluation_totals(evaluate(spark, sf_dir)).withColumns({"recall": F.round("recall", 6), "mrr": F.round("mrr", 6)})


_STOP = ", ".join(f"'{w}'" for w in understanding.STOPWORDS)
_CUES = ", ".join(sorted({f"'{w}'" for t in (understanding.TYPE_CUES, understanding.SUBTYPE_CUES, understanding.KIND_CUES) for ws in t.values() for w in ws.split()}))


@query(
    "understand_queries",
    f"""WITH w AS (SELECT item_id AS query_id, (regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))[1:8] AS w FROM benchmark)
SELECT query_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i AND x NOT IN ({_STOP}) AND x NOT IN ({_CUES})), ' ') AS tokens, array_to_string(w, ' ') || ' pdf' AS embed_text, 'pdf' AS types, {model.NOW - 14 * 86400} AS since FROM w""",
)
def understand_queries(spark, sf_dir):
    """The first eight words of each text, as someone would ask for a document of last week."""
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), 1, 8)
    raw = model.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.array_join(words, " "), F.lit(" last week pdf")).alias("raw"))
    out = understanding.understand_queries(raw, model.NOW)
    return out.select("query_id", F.array_join("tokens", " ").alias("tokens"), "embed_text", F.array_join("types", ",").alias("types"), "since")

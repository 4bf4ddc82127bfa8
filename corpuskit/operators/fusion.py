"""Hybrid ranking: weighted reciprocal ranks of a lexical and a vector leg, with boosts and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions.text import normalize_name, tokenize

RRF_K = 60
DAY = 86_400.0


def exact_boost(tokens: Column, title: Column, domain: Column) -> Column:
    """1.5 for the whole title, 1.3 for all words in the title, 1.3 for the host or its first label; the first that applies."""
    host = F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), r"^www\.", "")
    label = F.substring_index(host, ".", 1)
    any_host = (host != "") & (F.array_contains(tokens, host) | F.array_contains(tokens, label))
    return F.when(F.size(tokens) == 0, 1.0).when(normalize_name(title) == F.array_join(tokens, " "), 1.5).when(F.forall(tokens, lambda t: F.array_contains(tokenize(title), t)), 1.3).when(any_host, 1.3).otherwise(1.0)


def time_boost(captured: Column, since: Column, until: Column, now: Column) -> Column:
    """1.5 inside the window, falling to 1 over the window's own length (a day at least; 14 days if it has no start)."""
    end = F.coalesce(until, now)
    span = F.when(since.isNull(), 14 * DAY).otherwise(F.greatest(end - since, F.lit(DAY)))
    inside = (captured <= end) & (since.isNull() | (captured >= since))
    away = F.when(captured < since, since - captured).otherwise(captured - end)
    return F.when(captured.isNull(), 1.0).when(inside, 1.5).otherwise(1 + 0.5 * F.greatest(F.lit(0.0), 1 - away / span))


def recency_boost(captured: Column, now: Column) -> Column:
    return F.when(captured.isNull(), 1.0).otherwise(1 + 0.25 * F.exp(-F.greatest(F.lit(0.0), (now - captured) / DAY) / 60))


def matches_cue(type_: Column, kind: Column, types: Column, kinds: Column, subtype: Column | None = None, subtypes: Column | None = None) -> Column:
    found = lambda names, name: F.coalesce(F.array_contains(names, name), F.lit(False))
    either = found(types, type_) | found(kinds, kind)
    return either if subtype is None or subtypes is None else either | found(subtypes, subtype)


#: What fields are called in reasons, where not by their name.
FIELD_LABELS = {"retrieval_hints": "memory cues", "why_useful": "why it was kept", "vision_text": "what the image shows", "meta_text": "page details", "extracted_text": "content"}


def fuse(
    lexical: DataFrame, vector: DataFrame, items: DataFrame, queries: DataFrame, now: int, limit: int = 10, floor: float = 0.5, per_parent: int = 3,
    cues: DataFrame | None = None, few: int = 5, vector_weight: float | None = None,
) -> DataFrame:
    """``query_id, id, pos, score, reason, l_pos, cosine, bm25_norm, matched_fields`` of the best items; the last three are
    what was found, to three digits (the cosine only where it counted).

    lexical: ``query_id, id, pos`` and, where given, ``norm, fields``; vector: ``query_id, item_id, pos, cosine``; cues: ``query_id, id, pos`` of a leg that
    counts for queries with fewer than ``few`` lexical hits, and for items in no other leg; items: ``id, type, title,
    domain, captured_s, parent_id, deleted`` and, where given, ``kind, subtype, entities``; queries: ``query_id, tokens`` and,
    where given, ``phrases, since, until`` (epoch seconds), ``time_label``, ``types, subtypes, kinds`` (cued ones),
    ``domains, strict, note_cue``. Legs are
    cut before fusion, so they are small; items are joined slim. A strict query wants a cued type and the time window."""
    have = queries.columns
    given = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind).alias(c)
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) if c in have else F.array().cast("array<string>").alias(c)
    flag = lambda c: F.coalesce(given(c, "boolean"), F.lit(False)).alias(c)
    n_phrases = F.size("phrases") if "phrases" in have else F.lit(0)
    q = queries.select("query_id", "tokens", given("since", "long"), given("until", "long"), given("time_label", "string"), listed("types"), listed("kinds"), listed("subtypes"), listed("domains"), flag("strict"), flag("note_cue"), F.greatest(n_phrases, F.lit(0)).alias("n_phrases"))
    norm = F.col("norm") if "norm" in lexical.columns else F.lit(None).cast("double")
    fields = F.col("fields") if "fields" in lexical.columns else F.lit(None).cast("array<string>")
    lex = lexical.select("query_id", "id", F.col("pos").alias("l_pos"), F.round(norm, 3).alias("bm25_norm"), fields.alias("matched_fields"))
    vec = vector.select("query_id", F.col("item_id").alias("id"), F.col("pos").alias("v_pos"), "cosine")
    legs = lex.join(vec, ["query_id", "id"], "full_outer")
    if cues is None:
        legs = legs.withColumn("c_pos", F.lit(None).cast("int"))
    else:
        full = lex.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= few).select("query_id")
        legs = legs.join(cues.join(full, "query_id", "left_anti").select("query_id", "id", F.col("pos").alias("c_pos")), ["query_id", "id"], "full_outer")
    kind = F.col("kind") if "kind" in items.columns else F.lit(None).cast("string").alias("kind")
    entities = F.col("entities") if "entities" in items.columns else F.array().cast("array<string>").alias("entities")
    subtype = F.col("subtype") if "subtype" in items.columns else F.lit(None).cast("string").alias("subtype")
    live = items.filter("NOT deleted").select("id", "type", kind, subtype, "title", "domain", "captured_s", "parent_id", entities)
    h = legs.join(live, "id").join(q, "query_id").filter((F.col("type") != "note") | F.col("note_cue") | F.array_contains("types", "note"))
    strong = F.col("l_pos").isNotNull() | (F.col("cosine") >= floor)
    h = h.withColumn("v_pos", F.when(strong, F.col("v_pos"))).filter("l_pos IS NOT NULL OR v_pos IS NOT NULL OR c_pos IS NOT NULL")
    host = F.regexp_replace(F.lower(F.coalesce("domain", F.lit(""))), r"^www\.", "")
    h = h.filter((F.size("domains") == 0) | F.exists("domains", lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d))))
    has_cue = F.size("types") + F.size("kinds") + F.size("subtypes") > 0
    cued = matches_cue(F.col("type"), F.col("kind"), F.col("types"), F.col("kinds"), F.col("subtype"), F.col("subtypes"))
    timed, now_c = F.col("since").isNotNull() | F.col("until").isNotNull(), F.lit(now)
    in_time = time_boost(F.col("captured_s"), F.col("since"), F.col("until"), now_c)
    h = h.filter(~F.col("strict") | ((~has_cue | cued) & (~timed | (in_time >= 1.5))))
    v_weight = F.lit(vector_weight) if vector_weight is not None else F.when(F.size("tokens") + F.col("n_phrases") <= 2, 0.4).otherwise(1.0)
    ranks = F.coalesce(1.0 / (RRF_K + F.col("l_pos")), F.lit(0.0)) + F.coalesce(v_weight / (RRF_K + F.col("v_pos")), F.lit(0.0))
    only_cue = F.col("l_pos").isNull() & F.col("v_pos").isNull()
    ranks = F.when(only_cue, 0.3 / (RRF_K + F.col("c_pos")) * (1 + F.greatest(F.lit(0.0), F.coalesce("cosine", F.lit(0.0))))).otherwise(ranks)
    names = F.transform("entities", normalize_name)
    exact = exact_boost(F.col("tokens"), F.col("title"), F.col("domain"))
    named = (F.size("tokens") > 0) & (F.arrays_overlap(names, F.col("tokens")) | F.array_contains(names, F.array_join("tokens", " ")))
    in_title = F.forall("tokens", lambda t: F.array_contains(tokenize(F.col("title")), t))
    what = F.when(exact == 1.5, "exact title").when((exact == 1.3) & in_title, "title").when(exact == 1.3, "domain").when(F.coalesce(named, F.lit(False)), "entity")
    exact = F.when((exact == 1.0) & F.coalesce(named, F.lit(False)), 1.2).otherwise(exact)
    when = F.when(timed, in_time).otherwise(recency_boost(F.col("captured_s"), now_c))
    score = ranks * exact * F.when(cued, 1.35).otherwise(1.0) * when
    similar = F.concat(F.lit("similar meaning ("), F.format_number("cosine", 2), F.lit(")"))
    labels = F.create_map(*[F.lit(x) for kv in FIELD_LABELS.items() for x in kv])
    shown = F.transform(F.slice("matched_fields", 1, 3), lambda f: F.coalesce(F.try_element_at(labels, f), f))
    matches = F.when(F.col("l_pos").isNotNull(), F.when(F.col("matched_fields").isNull(), "Matches the text").when(F.size("matched_fields") > 0, F.concat(F.lit("Matches "), F.array_join(shown, ", "))))
    kept = F.concat(F.lit("kept "), F.coalesce("time_label", F.lit("in that time")))
    why = F.concat_ws(" · ", F.concat(F.lit("Exact "), what, F.lit(" match")), matches, F.when(F.col("v_pos").isNotNull() | only_cue, similar), F.when(cued, "the kind of thing you asked for"), F.when(timed & (in_time >= 1.5), kept))
    h = h.withColumn("cosine", F.when(F.col("v_pos").isNotNull() | only_cue, F.col("cosine")))
    order = [F.desc("score"), F.desc("captured_s"), F.col("id")]
    ranked = h.select("query_id", "id", "captured_s", "parent_id", F.round(score, 9).alias("score"), F.when(why == "", "Related to your search").otherwise(why).alias("reason"), "l_pos", F.round("cosine", 3).alias("cosine"), "bm25_norm", "matched_fields")
    sibling = F.row_number().over(Window.partitionBy("query_id", F.coalesce("parent_id", -F.col("id") - 1)).orderBy(*order))
    ranked = ranked.withColumn("sibling", sibling).filter(F.col("parent_id").isNull() | (F.col("sibling") <= per_parent))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return ranked.withColumn("pos", place).filter(F.col("pos") <= limit).select("query_id", "id", "pos", "score", "reason", "l_pos", "cosine", "bm25_norm", "matched_fields")


def semantic_search(vectors: DataFrame, queries: DataFrame, items: DataFrame, now: int, k: int = 10, floor: float = 0.5) -> DataFrame:
    """The vector leg alone, ``max(3 k, 20)`` deep, ranked as in ``fuse`` at full weight. queries: ``query_id, vector``."""
    from corpuskit.operators.vectors import knn

    hits = knn(vectors, queries, max(3 * k, 20))
    none = hits.select("query_id", F.col("item_id").alias("id"), "pos").filter(F.lit(False))
    asked = queries.select("query_id", F.array().cast("array<string>").alias("tokens"))
    return fuse(none, hits, items, asked, now, k, floor, vector_weight=1.0)


def holding(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """``query_id, id``: the texts (``id, text``) that hold a part (``query_id, part``), letter by letter.

    A word inside a part, neither its first nor its last, is a whole word of every text that holds it. Texts are looked
    through for the longest such word of each part only, and the few that have one are compared; a part without such a
    word is compared with all. The parts are sent to all tasks."""
    words = tokenize(F.col("part"))
    inner = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    asked = parts.filter("part IS NOT NULL").withColumn("word", F.array_max(inner)["w"])
    one = asked.agg(F.collect_set("word").alias("asked"))
    some = texts.crossJoin(F.broadcast(one)).select("id", "text", F.explode(F.array_intersect(tokenize(F.col("text")), F.col("asked"))).alias("word"))
    met = some.join(F.broadcast(asked.filter("word IS NOT NULL")), "word").unionByName(texts.crossJoin(F.broadcast(asked.filter("word IS NULL"))).select("id", "text", "word", "query_id", "part"))
    return met.filter(F.col("text").contains(F.col("part"))).select("query_id", "id").distinct()


def evaluate(hits: DataFrame, judgements: DataFrame, k: int = 3) -> DataFrame:
    """``query_id, rank, hit, rr``: place of the first expected item (null: none), whether it is within ``k``, and its
    reciprocal. hits: ``query_id, id, pos``; judgements: ``query_id, id``."""
    first = judgements.join(hits, ["query_id", "id"], "left").groupBy("query_id").agg(F.min("pos").alias("rank"))
    return first.select("query_id", "rank", F.coalesce(F.col("rank") <= k, F.lit(False)).alias("hit"), F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("rr"))


def evaluation_totals(evaluated: DataFrame) -> DataFrame:
    """``queries, hits, recall, mrr`` of the rows of ``evaluate``: one row, null shares where there is no query."""
    return evaluated.agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("double")).alias("recall"), F.avg("rr").alias("mrr"))


def acceptable_hits(hits: DataFrame, judgements: DataFrame, k: int = 3) -> DataFrame:
    """``query_id, acceptable, in_order`` of judgements ``query_id, id, role``: how many items of the roles ``expected``
    and ``acceptable`` are within ``k``, and whether the first expected one stands before every item of the role
    ``after`` (also where none of those is found, not where the expected one is missing)."""
    found = judgements.join(hits.select("query_id", "id", "pos"), ["query_id", "id"], "left")
    first = lambda role: F.min(F.when(F.col("role") == role, F.col("pos")))
    totals = found.groupBy("query_id").agg(F.count_if(F.col("role").isin("expected", "acceptable") & (F.col("pos") <= k)).alias("acceptable"), first("expected").alias("e"), first("after").alias("a"))
    return totals.select("query_id", "acceptable", (F.col("e").isNotNull() & F.coalesce(F.col("e") < F.col("a"), F.lit(True))).alias("in_order"))


def recall(hits: DataFrame, exact: DataFrame) -> DataFrame:
    """``queries, recall`` of one row: the mean share of each query's exact hits (``query_id, item_id``) that are among
    ``hits``; null without any."""
    wanted = exact.select("query_id", "item_id").join(hits.select("query_id", "item_id", F.lit(1).alias("there")), ["query_id", "item_id"], "left")
    share = wanted.groupBy("query_id").agg((F.count("there") / F.count("*")).alias("share"))
    return share.agg(F.count("*").alias("queries"), F.avg("share").alias("recall"))

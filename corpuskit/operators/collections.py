"""Collections and links as proposals: what is valid, what merges, what a set of subjects sees."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions.text import normalize_name, tokenize
from corpuskit.operators.linking import NAME_STOPWORDS, similar_names
from corpuskit.operators.records import union_lists
from corpuskit.sources.tables import written

# Names that say nothing.
GENERIC_NAMES = "technology websites website software internet articles article design misc miscellaneous links files images other stuff things notes research ai tools".split()
MIN_CONFIDENCE, MAX_PER_SUBJECT = 0.7, 5
NAME_FOLD, MIN_DESCRIPTION, MIN_MEMBERS = 0.6, 40, 2


def name_problem(name: Column) -> Column:
    """Why a collection may not have this name; null if it may."""
    key = normalize_name(F.coalesce(name, F.lit("")))
    return F.when(key == "", "empty").when(key.isin(*GENERIC_NAMES), "generic").when(F.size(F.split(key, " ")) < 2, "single word")


def name_similarity(a: Column, b: Column) -> Column:
    """Jaccard index of the words of two names; of names without words whether they are one."""
    words = lambda x: F.array_distinct(F.filter(tokenize(x), lambda t: ~t.isin(NAME_STOPWORDS)))
    shared = F.size(F.array_intersect(words(a), words(b)))
    bare = (F.size(words(a)) == 0) | (F.size(words(b)) == 0)
    same = normalize_name(a) == normalize_name(b)
    return F.when(bare, same.cast("double")).otherwise(shared / (F.size(words(a)) + F.size(words(b)) - shared))


def validate_edges(plan: DataFrame, subjects: DataFrame, candidates: DataFrame, edges: DataFrame, suppressions: DataFrame, least: float = MIN_CONFIDENCE, cap: int = MAX_PER_SUBJECT) -> DataFrame:
    """``plan_id, proposal_id, reason`` (null: accepted) of ``plan_id, proposal_id, source_id, target_id, confidence``.

    subjects, candidates: ``plan_id, id``; edges: ``source_id, target_id``; suppressions: ``a, b``. Rules on one proposal
    are joins over all plans. What is left depends on what was accepted before, one edge a pair and ``cap`` a subject,
    and is folded by plan, best confidence first."""
    pair = {"a": F.least("source_id", "target_id"), "b": F.greatest("source_id", "target_id")}
    p = plan.withColumns(pair)
    s = subjects.select("plan_id", "id").distinct()
    known = s.unionByName(candidates.select("plan_id", "id")).distinct()
    for side in ("source", "target"):
        p = p.join(s.select("plan_id", F.col("id").alias(f"{side}_id"), F.lit(True).alias(f"{side}_subject")), ["plan_id", f"{side}_id"], "left")
        p = p.join(known.select("plan_id", F.col("id").alias(f"{side}_id"), F.lit(True).alias(f"{side}_known")), ["plan_id", f"{side}_id"], "left")
    p = p.join(edges.select(*(c.alias(k) for k, c in pair.items())).distinct().withColumn("there", F.lit(True)), ["a", "b"], "left")
    p = p.join(suppressions.select("a", "b").distinct().withColumn("off", F.lit(True)), ["a", "b"], "left")
    alone = (
        F.when(F.col("source_id") == F.col("target_id"), "self")
        .when(F.col("there"), "connected")
        .when(F.col("source_known").isNull() | F.col("target_known").isNull(), "unknown")
        .when(F.col("source_subject").isNull() & F.col("target_subject").isNull(), "no subject")
        .when(F.coalesce(F.col("confidence"), F.lit(0.0)) < least, "confidence")
        .when(F.col("off"), "suppressed")
    )
    p = p.select("plan_id", "proposal_id", "a", "b", "confidence", F.when(F.col("source_subject"), F.col("source_id")).otherwise(F.col("target_id")).alias("subject"), alone.alias("reason"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        pairs, counts, out = set(), {}, []
        for r in group.sort_values(["confidence", "proposal_id"], ascending=[False, True], kind="stable").itertuples():
            reason = "pair" if (r.a, r.b) in pairs else "cap" if counts.get(r.subject, 0) >= cap else None
            if reason is None:
                pairs.add((r.a, r.b))
                counts[r.subject] = counts.get(r.subject, 0) + 1
            out.append((r.plan_id, r.proposal_id, reason))
        return pd.DataFrame(out, columns=["plan_id", "proposal_id", "reason"])

    kinds = dict(plan.dtypes)
    folded = p.filter("reason IS NULL").groupBy("plan_id").applyInPandas(fold, f"plan_id {kinds['plan_id']}, proposal_id {kinds['proposal_id']}, reason string")
    return p.filter("reason IS NOT NULL").select("plan_id", "proposal_id", "reason").unionByName(folded)


def cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def name_heads(keys: DataFrame) -> DataFrame:
    """``name_key, words, heads`` of distinct ``name_key``: the words that count, the rarest first, and those of them in
    which two names that are alike must meet (as in ``similar_names``); the key itself where it has no words."""
    words = F.array_distinct(F.filter(tokenize(F.col("name_key")), lambda t: ~t.isin(NAME_STOPWORDS)))
    cut = keys.select("name_key", words.alias("words"))
    each = cut.select("name_key", F.explode("words").alias("term"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    ranked = each.join(df, "term").repartition(cores(keys), "name_key").groupBy("name_key").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("w")).select("name_key", F.col("w.term").alias("words"))
    n = F.size("words")
    bare = cut.filter(n == 0).withColumn("heads", F.array(F.concat(F.lit("\u0000"), "name_key")))
    return ranked.withColumn("heads", F.slice("words", F.lit(1), (n - F.ceil(n * NAME_FOLD) + 1).cast("int"))).unionByName(bare)


def alike_names(asked: DataFrame, known: DataFrame, keys: DataFrame, *within: str) -> DataFrame:
    """``asked`` (name_key) beside the rows of ``known`` (name_key) whose names are the same or alike, ``within`` equal;
    each once. Names are compared by the words in ``keys`` (``name_heads``), which are cut once a name."""
    terms = lambda df: df.join(keys, "name_key").withColumn("term", F.explode("heads")).drop("heads")
    met = terms(asked).join(terms(known).withColumnsRenamed({"name_key": "_key", "words": "_words"}), ["term", *within])
    shared = F.size(F.array_intersect("words", "_words"))
    alike = (F.col("name_key") == F.col("_key")) | (F.try_divide(shared, F.size("words") + F.size("_words") - shared) >= NAME_FOLD)
    return met.filter(alike).drop("term", "words", "_words", "_key").distinct()


def validate_collections(plan: DataFrame, proposed: DataFrame, collections: DataFrame, items: DataFrame, suppressed: DataFrame) -> DataFrame:
    """``proposal_id, reason, into, members``: null reason: a new collection with that many members. ``into`` is the
    collection that a proposal folds into, ``into_proposal`` the accepted one of its plan.

    plan: ``proposal_id, name, description, confidence`` and, where given, ``plan_id`` (else all are of one plan);
    proposed: ``proposal_id, item_id``; collections: ``collection_id, name``; suppressed: ``name_key, item_id``. A name
    like that of a collection folds into it, and so does one like that of a proposal of the plan that was accepted
    before it, in the order of ids. What is asked of a proposal alone is joined; only proposals that are like an earlier
    acceptable one of their plan are folded in order, each with the list of those. Names are compared by key and words,
    each pair of names of a plan once, however many proposals have them."""
    plan = plan if "plan_id" in plan.columns else plan.withColumn("plan_id", F.lit(0))
    described = F.length(F.trim(F.coalesce("description", F.lit("")))) >= MIN_DESCRIPTION
    sure = F.coalesce("confidence", F.lit(0.0)) >= MIN_CONFIDENCE
    named = written(plan.select("plan_id", "proposal_id", normalize_name(F.coalesce("name", F.lit(""))).alias("name_key"), described.alias("described"), sure.alias("sure")), "proposals")
    named = named.withColumn("problem", name_problem(F.col("name_key")))
    known = collections.select(normalize_name(F.col("name")).alias("name_key"), "collection_id").filter("name_key IS NOT NULL").groupBy("name_key").agg(F.min("collection_id").alias("into"))
    asked = named.filter("problem IS NULL").select("name_key").distinct()
    keys = written(name_heads(asked.unionByName(known.select("name_key")).distinct()), "name-heads")
    folds = alike_names(asked, known, keys).groupBy("name_key").agg(F.min("into").alias("into"))
    live = items.filter("NOT deleted").select(F.col("id").alias("item_id"))
    eligible = proposed.distinct().join(live, "item_id", "left_semi").join(named.select("proposal_id", "name_key"), "proposal_id").join(suppressed.select("name_key", "item_id"), ["name_key", "item_id"], "left_anti")
    counted = eligible.groupBy("proposal_id").agg(F.count("*").alias("members"))
    p = named.join(folds, "name_key", "left").join(counted, "proposal_id", "left").withColumn("members", F.coalesce("members", F.lit(0)))
    fixed = F.coalesce("problem", F.when(F.col("into").isNotNull(), "folded"))
    reason = F.coalesce(fixed, F.when(~F.col("described"), "description").when(~F.col("sure"), "confidence").when(F.col("members") < MIN_MEMBERS, "members"))
    judged = written(p.select("plan_id", "proposal_id", "name_key", fixed.isNotNull().alias("fixed"), reason.alias("reason"), "into", "members"), "judged")
    # A proposal that fails on its own is never in the way of another; one with a bad name, or folded already, is not asked.
    # Of the acceptable ones of a name only the first can be accepted: the others fold into it, or into what it folds into.
    good = judged.filter("reason IS NULL").groupBy("plan_id", "name_key").agg(F.min("proposal_id").alias("earlier"))
    asked = judged.filter("NOT fixed").select("plan_id", "name_key", "proposal_id")
    near = alike_names(asked.select("plan_id", "name_key").distinct(), good, keys, "plan_id").select("plan_id", "name_key", "earlier")
    near = asked.join(near, ["plan_id", "name_key"]).filter("earlier < proposal_id").groupBy("plan_id", "proposal_id").agg(F.array_sort(F.collect_list("earlier")).alias("earlier"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan_id, taken = None, set()
        for frame in frames:
            out = []
            for r in frame.itertuples():
                if r.plan_id != plan_id:
                    plan_id, taken = r.plan_id, set()
                into = next((e for e in r.earlier if e not in taken), None)
                if into is not None:
                    taken.add(r.proposal_id)  # folded: in nobody's way
                    out.append((r.proposal_id, into))
            yield pd.DataFrame(out, columns=["proposal_id", "into_proposal"])

    kind = dict(plan.dtypes)["proposal_id"]
    # Rows of a plan follow each other in a task; they are few bytes, so Spark is told over how many tasks plans are dealt.
    in_order = near.repartition(cores(near), "plan_id").sortWithinPartitions("plan_id", "proposal_id")
    folded = in_order.mapInPandas(fold, f"proposal_id {kind}, into_proposal {kind}")
    out = judged.join(folded, "proposal_id", "left")
    return out.select("proposal_id", F.when(F.col("into_proposal").isNotNull(), "folded").otherwise(F.col("reason")).alias("reason"), "into", "into_proposal", "members")


def validate_names(requests: DataFrame, collections: DataFrame) -> DataFrame:
    """``request_id, name, name_key, reason`` of ``request_id, collection_id`` (null: create), ``name, actor``: names are
    trimmed, 1 to 80 characters, of a key of their own; an agent may not rename what a person named."""
    name = F.regexp_replace(F.trim(F.coalesce("name", F.lit(""))), r"\s+", " ")
    r = requests.select("request_id", "collection_id", "actor", name.alias("name"), normalize_name(name).alias("name_key"))
    keys = collections.select(normalize_name(F.col("name")).alias("name_key"), F.col("collection_id").alias("holder")).groupBy("name_key").agg(F.min("holder").alias("holder"), F.count("*").alias("holders"))
    r = r.join(keys, "name_key", "left").join(collections.select("collection_id", F.col("created_by").alias("owner")), "collection_id", "left")
    clash = F.col("holder").isNotNull() & ~(F.col("holder").eqNullSafe(F.col("collection_id")) & (F.col("holders") == 1))
    reason = F.when((F.col("actor") == "agent") & (F.col("owner") == "user"), "named by a person").when(F.col("name_key") == "", "empty").when(F.length("name") > 80, "too long").when(clash, "taken")
    return r.select("request_id", "name", "name_key", reason.alias("reason"))


def merge_collections(collections: DataFrame, members: DataFrame, plan: DataFrame, names: float = 0.5, overlap: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Collections without those that merge, and ``collection_id, item_id`` of the members afterwards. plan: ``source,
    into``; both must be made by agents and be alike in name or share so many of the source's members. A source that is
    itself merged into is left; only the first target (by id) of a source counts."""
    made = collections.filter("created_by = 'agent'")
    p = plan.filter("source <> into").join(made.select(F.col("collection_id").alias("source"), F.col("name").alias("n1")), "source").join(made.select(F.col("collection_id").alias("into"), F.col("name").alias("n2")), "into")
    m = members.select("collection_id", "item_id").distinct()
    sizes = m.groupBy(F.col("collection_id").alias("source")).agg(F.count("*").alias("size"))
    of_source = p.select("source", "into").join(m.select(F.col("collection_id").alias("source"), "item_id"), "source")
    shared = of_source.join(m.select(F.col("collection_id").alias("into"), "item_id"), ["into", "item_id"]).groupBy("source", "into").agg(F.count("*").alias("shared"))
    p = p.join(sizes, "source", "left").join(shared, ["source", "into"], "left")
    alike = (name_similarity(F.col("n1"), F.col("n2")) >= names) | (F.coalesce(F.col("shared"), F.lit(0)) >= F.col("size") * overlap)
    good = p.filter(F.coalesce(alike, F.lit(False))).groupBy("source").agg(F.min("into").alias("into"))
    good = good.join(good.select(F.col("into").alias("source")).distinct(), "source", "left_anti")
    moved = m.join(good.select(F.col("source").alias("collection_id"), "into"), "collection_id", "left").select(F.coalesce("into", "collection_id").alias("collection_id"), "item_id").distinct()
    return collections.join(good.select(F.col("source").alias("collection_id")), "collection_id", "left_anti").select(*collections.columns), moved


def collection_context(candidates: DataFrame, subjects: DataFrame, collections: DataFrame, k: int = 30, of_subjects: int = 8) -> DataFrame:
    """``request_id, collection_id, name, cosine, pos``: the collections that a set of subjects sees, the nearest to any of
    its first ``of_subjects`` first, then by name. candidates: ``item_id, collection_id, cosine``; subjects: ``request_id,
    pos, item_id``. Collections without a cosine follow by name: only the first ``k`` names can be among them."""
    near = subjects.filter(F.col("pos") <= of_subjects).join(candidates, "item_id").groupBy("request_id", "collection_id").agg(F.max("cosine").alias("cosine"))
    known = near.join(collections.select("collection_id", "name"), "collection_id")
    first = collections.select("collection_id", "name").orderBy("name", "collection_id").limit(2 * k)
    asked = subjects.select("request_id").distinct().withColumn("heads", F.lit(1)).join(F.broadcast(first.groupBy(F.lit(1).alias("heads")).agg(F.collect_list(F.struct("collection_id", "name")).alias("c"))), "heads")
    others = asked.select("request_id", F.explode("c").alias("c")).select("request_id", "c.*").join(near.select("request_id", "collection_id"), ["request_id", "collection_id"], "left_anti").withColumn("cosine", F.lit(None).cast("double"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc_nulls_last("cosine"), "name", "collection_id"))
    return known.select("request_id", "collection_id", "name", "cosine").unionByName(others.select("request_id", "collection_id", "name", "cosine")).withColumn("pos", place).filter(F.col("pos") <= k)


def sweep_items(items: DataFrame, batches: DataFrame, collections: DataFrame, members: DataFrame, newest: int = 40, most: int = 120) -> DataFrame:
    """``id, rank, pos``: what a sweep looks at: items of the batches, members of agents' collections, the newest
    top-level ones; live, no notes, each once at its best rank."""
    live = items.filter("NOT deleted AND type <> 'note'")
    a = live.join(batches.select("batch_id").distinct(), "batch_id", "left_semi").select("id", F.lit(0).alias("rank"), "captured_s")
    of_agents = members.join(collections.filter("created_by = 'agent'").select("collection_id"), "collection_id", "left_semi").select(F.col("item_id").alias("id")).distinct()
    b = live.join(of_agents, "id", "left_semi").select("id", F.lit(1).alias("rank"), "captured_s")
    c = live.filter("parent_id IS NULL").orderBy(F.desc("captured_s"), "id").limit(newest).select("id", F.lit(2).alias("rank"), "captured_s")
    once = a.unionByName(b).unionByName(c).groupBy("id").agg(F.min("rank").alias("rank"), F.max("captured_s").alias("captured_s"))
    top = once.orderBy("rank", F.desc("captured_s"), "id").limit(most)
    return top.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank", F.desc("captured_s"), "id"))).select("id", "rank", "pos")


def propose_links(candidates: DataFrame, contexts: DataFrame, k: int = 3, near: float = 0.6, project: float = 0.7, join_at: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Edges ``source_id, target_id, type, confidence`` and memberships ``collection_id, item_id, confidence`` that follow
    from rank and likeness. candidates: ``id, other, cosine, flags, n_entities, pos``; contexts: ``item_id,
    collection_id, cosine``. At most ``k`` edges an item, in order of the candidates."""
    cosine = F.coalesce("cosine", F.lit(0.0))
    flagged = F.arrays_overlap("flags", F.array(*map(F.lit, ("same_domain", "same_owner", "same_folder"))))
    fit = candidates.filter((F.col("id") != F.col("other")) & ((cosine >= near) | F.coalesce(flagged, F.lit(False))))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("pos", "other"))
    kind = F.when((F.col("n_entities") > 0) & (cosine >= project), "same_project").otherwise("related_to")
    sure = F.least(F.lit(0.9), F.greatest(F.lit(0.6), F.round(cosine, 2)))
    edges = fit.withColumn("nth", nth).filter(F.col("nth") <= k).select(F.col("id").alias("source_id"), F.col("other").alias("target_id"), kind.alias("type"), sure.alias("confidence"))
    joins = contexts.filter(F.col("cosine") >= join_at).select("collection_id", "item_id", F.least(F.lit(0.85), F.col("cosine")).alias("confidence"))
    return edges, joins


def apply_proposals(proposals: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items after tags and renames, the memberships that follow, and ``proposal_id, kind`` of what is not applied.

    proposals: ``proposal_id, kind`` (add, create, tag, rename, trash), ``item_id, collection_id, values`` (list),
    ``title``; items: ``id, title, topics, overrides, deleted``. Trash is only ever staged, and what a person holds fast
    or is gone stays. Several tags of an item follow each other; the last of several titles stays."""
    live = items.select(F.col("id").alias("item_id"), "overrides", F.col("deleted").alias("_gone"), F.lit(True).alias("_here"))
    p = proposals.join(live, "item_id", "left")
    held = lambda f: F.coalesce(F.try_element_at("overrides", F.lit(f)), F.lit(False))
    here = F.coalesce(F.col("_here"), F.lit(False)) & ~F.coalesce(F.col("_gone"), F.lit(False))
    good = here & F.when(F.col("kind") == "tag", ~held("topics")).when(F.col("kind") == "rename", ~held("title")).otherwise(F.col("kind").isin("add", "create"))
    p = p.withColumn("good", F.coalesce(good, F.lit(False)))
    tags = p.filter("good AND kind = 'tag'").groupBy(F.col("item_id").alias("id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("proposal_id", "values"))), lambda x: x["values"])).alias("more"))
    titles = p.filter("good AND kind = 'rename'").groupBy(F.col("item_id").alias("id")).agg(F.max_by("title", "proposal_id").alias("new_title"))
    after = items.join(tags, "id", "left").join(titles, "id", "left")
    topics = F.when(F.col("more").isNotNull(), union_lists(F.col("topics"), F.col("more"), 6)).otherwise(F.col("topics"))
    after = after.withColumns({"topics": topics, "title": F.coalesce(F.substring("new_title", 1, 160), "title")}).select(*items.columns)
    joined = p.filter("good AND kind IN ('add', 'create')").select("collection_id", "item_id").distinct()
    return after, joined, p.filter("NOT good").select("proposal_id", "kind")


def runs_for(runs: DataFrame, audit: DataFrame, items: DataFrame, ids: DataFrame, k: int = 20) -> DataFrame:
    """``id, run_id, undoable, pos``: the latest runs of an item or of its batch; undoable while an entry of the log that
    is not undone names the run. runs: ``run_id, item_id, batch_id, started_us``; audit: ``run_id, undone``."""
    asked = ids.select("id").distinct()
    own = runs.join(asked.select(F.col("id").alias("item_id")), "item_id").select(F.col("item_id").alias("id"), "run_id", "started_us")
    of_batch = items.join(asked, "id", "left_semi").filter("batch_id IS NOT NULL").select("id", "batch_id").join(runs.select("run_id", "batch_id", "started_us"), "batch_id").select("id", "run_id", "started_us")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("started_us"), "run_id"))
    top = own.unionByName(of_batch).distinct().withColumn("pos", place).filter(F.col("pos") <= k)
    open_runs = audit.filter("NOT undone AND run_id IS NOT NULL").select("run_id").distinct().withColumn("undoable", F.lit(True))
    return top.join(open_runs, "run_id", "left").select("id", "run_id", F.coalesce("undoable", F.lit(False)).alias("undoable"), "pos")


def active_progress(stage_events: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, stage, outcome, title, live``: the last event of every item and stage that is not finished, beside what
    the item is (nulls where it is gone)."""
    last = stage_events.groupBy("item_id", "stage").agg(F.max_by("outcome", F.struct("at_us", "seq")).alias("outcome")).filter("outcome <> 'ok'")
    of = items.select(F.col("id").alias("item_id"), "title", (~F.col("deleted")).alias("live"))
    return last.join(of, "item_id", "left").select("item_id", "stage", "outcome", "title", "live")


def known_facts(ids: DataFrame, members: DataFrame, edges: DataFrame, pairs_off: DataFrame, members_off: DataFrame, k: int = 20) -> DataFrame:
    """``id, fact, other, about, pos``: what a person settled about an item. members: ``collection_id, item_id,
    added_by``; edges: ``source_id, target_id, type, created_by``; pairs_off: ``a, b``; members_off: ``name_key, item_id``."""
    asked = ids.select("id").distinct()
    mine = members.filter("added_by = 'user'").select(F.col("item_id").alias("id"), F.lit("member").alias("fact"), F.col("collection_id").alias("other"), F.lit(None).cast("string").alias("about"))
    e = edges.filter("created_by = 'user'").select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("other")), F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("other")))).alias("x"), "type")
    linked = e.select("x.id", F.lit("linked").alias("fact"), "x.other", F.col("type").alias("about"))
    off = pairs_off.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("x")).select("x.id", F.lit("never link").alias("fact"), "x.other", F.lit(None).cast("string").alias("about"))
    never = members_off.select(F.col("item_id").alias("id"), F.lit("never add").alias("fact"), F.lit(None).cast("long").alias("other"), F.col("name_key").alias("about"))
    every = mine.unionByName(linked).unionByName(off).unionByName(never).join(asked, "id", "left_semi").distinct()
    place = F.row_number().over(Window.partitionBy("id").orderBy("fact", "other", "about"))
    return every.withColumn("pos", place).filter(F.col("pos") <= k)

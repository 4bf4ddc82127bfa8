"""The stored index and the whole search: phrases, pruning, snippets, evidence."""

from __future__ import annotations

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import fusion, index, lexical
from corpuskit.operators import queries as understanding
from corpuskit.plans import collection_queries, model, registry
from corpuskit.sources import tables

TEXTS = [(i, "zebra tent lantern") for i in range(60)] + [
    (100, "A long page about lamps. " * 30 + 'He lit the zebra lantern, the one "Zebra Lantern" of 1900. ' + "More about lamps. " * 30),
    (101, "lantern zebra"),
    (102, None),
    (103, ""),
    (104, "\u0130stanbul -- zebra; zebra (tent) lantern\n\nzebra"),
]
DOC = "id long, type string, kind string, title string, domain string, extracted_text string, lang string, captured_s long, batch_id long, parent_id long, deleted boolean"


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, "text", None, f"Item {i}", "d.org", t, "en", 1_700_000_000 + i, 0, None, i == 59) for i, t in TEXTS], DOC)


@pytest.fixture(scope="module")
def idx(items):
    return tables.stored_index(index.item_fields(items))


def ask(spark, *raw):
    return understanding.understand_queries(spark.createDataFrame(list(enumerate(raw)), "query_id long, raw string"), model.NOW)


def test_phrases_are_part_of_the_match(spark, items, idx):
    """Sixty short texts hold both words apart; the long one is the only one with the phrase."""
    got = {}
    for r in collection_queries.search(spark, items, ask(spark, 'zebra lantern "zebra lantern"', '"zebra lantern"', '"zebra lantern" unicorn', "nothing here matches", ""), idx).collect():
        got.setdefault(r.query_id, []).append(r)
    best = min(got[1], key=lambda r: r.pos)
    assert best.id == 100 and "[[zebra]] [[lantern]]" in best.snippet and best.matched_fields == ["extracted_text"] and best.bm25_norm == 1.0
    assert best.reason.startswith("Matches content")
    _, _, lex = collection_queries.word_leg(ask(spark, 'zebra lantern "zebra lantern"', '"zebra lantern" unicorn'), idx)
    hits = {(r.query_id, r.pos): (r.id, r["mode"]) for r in lex.collect()}
    assert hits[0, 1] == (100, "and") and hits[1, 1] == (100, "or") and sum(q == 0 for q, _ in hits) == 40
    assert {r.id for r in got[1] if r.matched_fields} == {100}
    assert 4 not in got and all(not r.matched_fields for r in got.get(3, []))


def test_phrase_match(spark, idx):
    phrases = spark.createDataFrame([(1, ["zebra", "lantern"]), (2, ["zebra", "zebra"]), (3, ["lantern", "zebra"]), (4, ["zebra"]), (5, []), (6, ["absent", "zebra"])], "query_id long, tokens array<string>")
    got = {}
    for r in lexical.phrase_match(idx, phrases).collect():
        got.setdefault(r.query_id, {})[r.id] = r.n
    assert got[1] == {100: 2}
    words = {i: re.findall(r"[^\W_]+", (t or "").lower().replace("i\u0307", "i ")) for i, t in TEXTS if i != 59}
    for q, p in ((1, ["zebra", "lantern"]), (2, ["zebra", "zebra"]), (3, ["lantern", "zebra"]), (4, ["zebra"])):
        want = {i: n for i, w in words.items() if (n := sum(w[k : k + len(p)] == p for k in range(len(w))))}
        assert got.get(q, {}) == want
    assert 5 not in got and 6 not in got


def test_phrases_rank_like_sqlite(spark):
    rows = [(0, "red fox", "the red fox jumps, a red fox"), (1, "blue", "fox red"), (2, "whale", "whales and a red fox here"), (3, "other", "nothing"), (4, "more", "even less red to see here")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(title, extracted_text)")
    con.executemany("INSERT INTO f(rowid, title, extracted_text) VALUES (?, ?, ?)", rows)
    items = spark.createDataFrame([(*r, False) for r in rows], "id long, title string, extracted_text string, deleted boolean")
    idx = tables.stored_index(index.item_fields(items))
    for tokens, phrases, match in (([], [["red", "fox"]], '"red fox"'), (["whales"], [["red", "fox"]], 'whales OR "red fox"'), (["red", "here"], [["fox", "here"]], 'red OR here OR "fox here"')):
        want = dict(con.execute("SELECT rowid, bm25(f, 8.0, 1.0) FROM f WHERE f MATCH ?", (match,)).fetchall())
        q = spark.createDataFrame([(1, tokens, phrases)], "query_id long, tokens array<string>, phrases array<array<string>>")
        got = {r.id: r["rank"] for r in lexical.bm25(idx, lexical.match_groups(q)).collect()}
        assert got == pytest.approx(want)


def test_search_reads_the_index_only(spark, idx, items):
    """No plan of phrases or snippets scans a text; a search reads the buckets of its terms only."""
    phrases = spark.createDataFrame([(1, ["zebra", "lantern"])], "query_id long, tokens array<string>")
    groups = spark.createDataFrame([(1, 0, "zebra lantern"), (1, 1, "tent")], "query_id long, group_no int, term string")
    found = lexical.phrase_match(idx, phrases)
    hits = lexical.search_groups(idx, groups)
    lit = lexical.snippets(idx, hits, groups)
    # What is read is the index, or was just taken out of it.
    assert found.inputFiles() and all(re.search("/(index|asked-terms|asked-postings|phrase-words|windows)-", f) for f in [*found.inputFiles(), *lit.inputFiles()])
    assert {r.query_id for r in lit.collect()} == {1}
    words = groups.select(F.explode(F.split("term", " ")).alias("term"))
    asked = {r[0] for r in words.select(index.bucket_of(F.col("term"), tables.BUCKETS)).distinct().collect()}
    assert len(asked) <= 3
    near = index.pruned(idx, words)
    read = {r[0] for r in near.postings.select("bucket").distinct().collect()}
    assert read <= asked and near.postings.count() < idx.postings.count() / 2
    assert "bucket" in near.postings._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]


def test_snippets_of_odd_letters(spark, idx):
    """A dotted capital I is two characters in small letters, of which the second parts words."""
    groups = spark.createDataFrame([(1, 0, "zebra"), (1, 1, "stanbul")], "query_id long, group_no int, term string")
    hits = spark.createDataFrame([(1, 104)], "query_id long, id long")
    (r,) = lexical.snippets(idx, hits, groups).collect()
    assert r.snippet.count("[[zebra]]") == 3 and "[[stanbul]]" in r.snippet and "[[lantern]]" not in r.snippet


def test_cue_words_alone(spark):
    """Cue words are searched for where a query has nothing else, all of them together."""
    items = spark.createDataFrame([(1, "old screenshot", False), (2, "screenshot and pdf", False), (3, "pdf", False)], "id long, title string, deleted boolean")
    idx = tables.stored_index(index.item_fields(items))
    hits = lexical.search_groups(idx, lexical.match_groups(ask(spark, "pdf screenshot", "pdf old")))
    assert sorted((r.query_id, r.id, r["mode"]) for r in hits.collect()) == [(0, 2, "and"), (1, 1, "and")]


def test_prefix_of_the_token_only(spark):
    items = spark.createDataFrame([(1, "reporter", False), (2, "repositoryx", False), (3, "repository", False)], "id long, title string, deleted boolean")
    idx = tables.stored_index(index.item_fields(items))
    q = spark.createDataFrame([(1, ["repo"])], "query_id long, tokens array<string>")
    terms = {r.term for r in lexical.match_groups(q, prefixes=idx).collect()}
    assert terms == {"repo", "repository", "repositoryx", "reporter"}
    q = spark.createDataFrame([(1, ["js"])], "query_id long, tokens array<string>")
    assert {r.term for r in lexical.match_groups(q, prefixes=idx).collect()} == {"js", "javascript"}


def test_subtypes_and_reasons(spark):
    day = 86_400
    rows = [(1, "url", "github_repo", "alpha beta", None, ["Ada"]), (2, "url", None, "alpha", "beta.org", ["Beta"]), (3, "image", "screenshot", "other", None, [])]
    items = spark.createDataFrame([(i, t, s, ti, d, model.NOW - day, None, False, e) for i, t, s, ti, d, e in rows], "id long, type string, subtype string, title string, domain string, captured_s long, parent_id long, deleted boolean, entities array<string>")
    lex = spark.createDataFrame([(1, 1, 1, 1.0, ["title", "extracted_text", "why_useful", "kind"]), (1, 2, 2, 0.5, ["title"]), (1, 3, 3, 0.25, ["vision_text"])], "query_id long, id long, pos int, norm double, fields array<string>")
    vec = spark.createDataFrame([(1, 1, 1, 0.6123), (1, 3, 2, 0.1)], "query_id long, item_id long, pos int, cosine double")
    q = spark.createDataFrame([(1, ["beta"], ["github_repo"], model.NOW - 2 * day, "yesterday")], "query_id long, tokens array<string>, subtypes array<string>, since long, time_label string")
    got = {r.id: r for r in fusion.fuse(lex, vec, items, q, model.NOW).collect()}
    assert got[1].reason == "Exact title match · Matches title, content, why it was kept · similar meaning (0.61) · the kind of thing you asked for · kept yesterday"
    assert got[2].reason == "Exact domain match · Matches title · kept yesterday" and got[2].bm25_norm == 0.5 and got[2].cosine is None
    assert got[3].reason == "Matches what the image shows · similar meaning (0.10) · kept yesterday" and got[1].cosine == 0.612
    assert got[1].score == pytest.approx((1 / 61 + 0.4 / 61) * 1.3 * 1.35 * 1.5)
    strict = q.withColumn("strict", F.lit(True))
    assert {r.id for r in fusion.fuse(lex, vec, items, strict, model.NOW).collect()} == {1}


def test_shared_index_is_built_once(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame([(1, "one two")], "id long, title string").write.parquet(path)
    built = []

    def fields():
        built.append(1)
        return index.item_fields(spark.read.parquet(path))

    terms = lambda parts=False: {r.term for r in tables.shared_index(spark, [path], fields, parts).term_stats.collect()}
    assert terms() == terms() == {"one", "two"} and len(built) == 1
    assert terms(parts=True) == {"one", "two"} and len(built) == 2
    spark.createDataFrame([(2, "three")], "id long, title string").write.mode("append").parquet(path)
    assert terms() == {"one", "two", "three"} and len(built) == 3


def test_whole_search_over_the_tables(spark, sf_dir):
    rows = registry.queries()["search_library"](spark, sf_dir).collect()
    assert rows and all(r.pos <= 10 and r.snippet is not None or r.snippet is None for r in rows)
    asked = {r.query_id for r in collection_queries.raw_queries(spark, sf_dir).collect()}
    assert {r.query_id for r in rows} <= asked and len({(r.query_id, r.pos) for r in rows}) == len(rows)


def test_bags_meet_items_without_a_row_a_pair(spark, items, idx, monkeypatch):
    """The best others of every item are those of ``bm25`` over all pairs, in blocks of one item or of all."""
    asks = items.filter("NOT deleted").select("id", F.coalesce("extracted_text", F.lit("Item")).alias("text"))
    words = F.array_distinct(lexical.tokenize(F.col("text")))
    groups = asks.select(F.col("id").alias("query_id"), F.posexplode(F.slice(words, 1, 24)).alias("group_no", "term")).filter("length(term) >= 2")
    best = {}
    for r in sorted(lexical.bm25(idx, groups).filter("query_id <> id").collect(), key=lambda r: (round(r["rank"], 9), r.id)):
        best.setdefault(r.query_id, []).append(r.id)
    want = {(q, o, i + 1) for q, others in best.items() for i, o in enumerate(others[:10])}
    monkeypatch.setattr(lexical, "bm25", None)  # it gives a row a pair
    for size, share in ((32_768, 1 / 16), (1, 2.0)):
        monkeypatch.setattr(lexical, "ITEM_BLOCK", size)
        monkeypatch.setattr(lexical, "COMMON", share)
        assert {(r.id, r.other, r.pos) for r in lexical.bag_candidates(idx, asks).collect()} == want


def test_index_blocks_do_not_travel(spark, items, monkeypatch):
    """Postings are written by the task that made them; what is dealt by bucket are terms and counts."""
    dealt, kind = [], type(items)
    repartition = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *a: dealt.append(self.columns) or repartition(self, *a))
    fields = index.item_fields(items)
    idx = tables.stored_index(fields, "still", parts=False)
    assert dealt and not any("block" in columns for columns in dealt)
    want = index.build_index(index.index_docs(items))
    for name in ("postings", "term_stats", "doc_stats", "totals"):
        rows = lambda i: sorted(map(repr, getattr(i, name).select(getattr(want, name).columns).collect()))  # noqa: B023, E731
        assert rows(idx) == rows(want)


def test_scores_are_summed_by_blocks_of_items(spark, idx, monkeypatch):
    """A word of several groups, several words of a group, a word that no item has: by hand, in blocks of one item or all."""
    rows = [(1, 0, "zebra"), (1, 1, "zebra"), (1, 1, "tent"), (1, 2, "unicorn"), (2, 0, "lantern"), (2, 0, "zebra"), (2, 1, "lamps"), (3, 0, "unicorn")]
    groups = spark.createDataFrame(rows, "query_id long, group_no int, term string")
    stats = {r.term: r.df for r in idx.term_stats.collect()}
    n, avg = idx.totals.select("n_docs", "avg_tokens").first()
    f, size = {}, {}
    for r in idx.postings.collect():
        f[r.term, r.id] = f.get((r.term, r.id), 0) + index.FIELD_WEIGHTS[r.field] * r.tf
        size[r.id] = r.n_tokens
    import math

    def gain(t, i):
        idf = math.log((n - stats[t] + 0.5) / (stats[t] + 0.5))
        return (idf if idf > 0 else 1e-6) * f[t, i] * 2.2 / (f[t, i] + 1.2 * (0.25 + 0.75 * size[i] / avg))

    want = {}
    for q, g, t in rows:
        for i in size:
            if (t, i) in f:
                score, matched = want.setdefault((q, i), [0.0, set()])
                want[q, i] = [score - gain(t, i), matched | {g}]
    want = {(*at, round(s, 8), len(m)) for at, (s, m) in want.items()}
    for block in (8192, 1):
        monkeypatch.setattr(lexical, "SCORE_BLOCK", block)
        assert {(r.query_id, r.id, round(r["rank"], 8), r.groups) for r in lexical.bm25(idx, groups).collect()} == want
        plan = lexical.search_groups(idx, groups)._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "Join Inner, (term" not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_holding(spark):
    """Parts of one word, of none and of words that are cut at both ends, also where the second word is cut."""
    texts = spark.createDataFrame([(1, "Then he lit the lamp. Again!"), (2, "THEN HE LIT THE LAMP"), (3, "..."), (4, None), (5, "unlamped")], "id long, text string")
    parts = spark.createDataFrame([(1, "en he lit th"), (2, "lamp"), (3, ".."), (4, "Then he li"), (5, "d he"), (6, ""), (7, None)], "query_id long, part string")
    got = {tuple(r) for r in fusion.holding(texts, parts).collect()}
    assert got == {(1, 1), (2, 1), (2, 5), (3, 3), (4, 1), *((6, i) for i in (1, 2, 3, 5))}


def test_long_texts_come_to_python_in_pieces(spark, monkeypatch):
    """No row that Python gets grows with a text, and postings are whole however pieces and groups of tokens are cut."""
    long = " ".join(f"w{i % 300}" for i in range(5000))
    rows = [(1, [("title", "a b a"), ("domain", "")]), (2, []), (3, [("extracted_text", long), ("title", "w7 end")]), (4, [("title", None), ("kind", "zed")]), (5, [("title", long)])]
    fields = spark.createDataFrame(rows, "id long, fields array<struct<field: string, text: string>>").coalesce(1)
    want = {}
    for i, fs in rows:
        for field, text in fs:
            for at, t in enumerate((text or "").split()):
                want.setdefault((t, i, field), []).append(at)
    size = {i: sum(len((t or "").split()) for _, t in fs) for i, fs in rows}
    given, kind = [], type(fields)
    arrow = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **k: given.append(self) or arrow(self, *a, **k))
    for at_once in (500_000, 300, 1):
        monkeypatch.setattr(index, "TOKENS_AT_ONCE", at_once)
        got = index.postings_of(fields).collect()
        assert {(r.term, r.id, r.field): r.positions for r in got if r.term is not None} == want
        assert sorted((r.id, r.tf) for r in got if r.term is None) == sorted(size.items())
        assert all(r.n_tokens == size[r.id] for r in got)
        assert sorted((r.term, r.id) for r in got if r.lead and r.term is not None) == sorted({(t, i) for t, i, _ in want})
    assert given and all(g.select(F.max(F.length(F.to_json(F.struct(*g.columns))))).first()[0] < 4000 for g in given)


def test_bags_hold_only_their_best(spark, monkeypatch):
    """Words that are left out, looked up later or kept for all items of a block: the best are those of all pairs. No bag
    travels once a block, and no other row than the best leaves a task."""
    draw = random.Random(7)
    words = [f"w{i}" for i in range(80)]
    texts = [(f"i{i:03d}", " ".join(draw.choices(words, [1 / (j + 1) for j in range(80)], k=draw.randint(0, 12)))) for i in range(300)]
    texts += [(f"j{i:03d}", texts[i][1]) for i in range(0, 300, 9)]
    items = spark.createDataFrame(texts, "id string, title string")
    idx = tables.stored_index(index.item_fields(items), "bags", parts=False)
    bags = spark.createDataFrame([(i, sorted(set(t.split()))) for i, t in texts if t], "bag string, words array<string>")
    best = {}
    groups = bags.select(F.col("bag").alias("query_id"), F.posexplode("words").alias("group_no", "term"))
    for r in sorted(lexical.bm25(idx, groups).collect(), key=lambda r: (round(r["rank"], 9), r.id)):
        best.setdefault(r.query_id, []).append((r.id, round(r["rank"], 7)))
    for block, share, cells, rows in ((64, 1 / 16, 1 << 20, 1000), (16, 1 / 4, 40, 50), (300, 2.0, 1, 7)):
        for name, value in (("ITEM_BLOCK", block), ("COMMON", share), ("CELLS", cells), ("PACKED_ROWS", rows)):
            monkeypatch.setattr(lexical, name, value)
        found = lexical.best_of_bags(idx, bags, 4)
        got = {}
        for r in sorted(found.collect(), key=lambda r: (r.bag, round(r["rank"], 9), r.id)):
            got.setdefault(r.bag, []).append((r.id, round(r["rank"], 7)))
        assert got == {b: x[:4] for b, x in best.items()}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CoGroup" not in plan and "Window" not in plan


def test_phrases_meet_packed_blocks(spark, monkeypatch):
    """Phrases with a word twice, with words that no item has, and over blocks of any size, as brute force finds them; no
    list of places is dealt by phrase, and blocks get only what queries ask of the words that they have."""
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choices("abcd", k=draw.randint(0, 30))), draw.choice("ab")) for i in range(90)]
    idx = tables.stored_index(index.item_fields(spark.createDataFrame(rows, "id long, extracted_text string, title string")), "phrased", parts=False)
    phrases = [["a", "b"], ["a", "a", "b"], ["c", "d", "a", "b"], ["d"], ["a", "z"], ["z"], ["b", "a", "b", "a"], ["d", "d"]]
    want = {}
    for q, p in enumerate(phrases):
        for i, *texts in rows:
            for field, t in zip(("extracted_text", "title"), texts, strict=True):
                t = t.split()
                if n := sum(t[j : j + len(p)] == p for j in range(len(t) - len(p) + 1)):
                    want[q, i, field] = n
    asked = spark.createDataFrame(list(enumerate(phrases)), "query_id long, tokens array<string>")
    groups = asked.select("query_id", F.lit(0).alias("group_no"), F.array_join("tokens", " ").alias("term"))
    for block, packed in ((8192, 1000), (15, 11)):
        monkeypatch.setattr(lexical, "SCORE_BLOCK", block)
        monkeypatch.setattr(lexical, "PACKED_ROWS", packed)
        found = lexical.phrase_match(idx, asked)
        assert {(r.query_id, r.id, r.field): r.n for r in found.collect()} == want
        assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    hits = lexical.search_groups(idx, groups)
    assert {(r.query_id, r.id) for r in hits.collect()} <= {k[:2] for k in want}
    assert "sequence(" not in hits._jdf.queryExecution().optimizedPlan().toString()

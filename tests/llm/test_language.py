import numpy as np
import pytest

from corpuskit.llm import language


def phrases(text, sample):
    """Greedy longest matches; a character without match is one phrase."""
    n, at = 0, 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at += max(1, size)
        n += 1
    return n


@pytest.mark.parametrize("table", [language.TABLE, 0])
def test_automaton_parses_like_substring_search(monkeypatch, table):
    monkeypatch.setattr(language, "TABLE", table)
    rng = np.random.default_rng(2)
    alphabet = "abcd "
    samples = {k: "".join(rng.choice(list(alphabet), 300, p=p)) for k, p in (("x", [0.4, 0.1, 0.2, 0.1, 0.2]), ("y", [0.1, 0.4, 0.1, 0.2, 0.2]))}
    model = language.model_of({k: [v] for k, v in samples.items()}, 10_000, 10_000)
    squeeze = lambda s: " ".join(s.split()) if not s[:1].isspace() and not s[-1:].isspace() else (" " * s[:1].isspace() + " ".join(s.split()) + " " * s[-1:].isspace())
    folded = {k: squeeze(v) + ("" if v[-1:] == " " else "") + " " for k, v in samples.items()}
    folded = {k: " ".join(v.split(" ")) for k, v in folded.items()}
    texts = ["".join(rng.choice(list(alphabet + "z"), rng.integers(0, 400))) for _ in range(40)] + ["".join(rng.choice(list(alphabet + "z"), 5000)) for _ in range(3)] + ["ab" * 3000, "a" * 4000, "b" * 1537] + ["", " ", "a", "zz"]
    got, letters = language.Parser(model).phrases(texts)
    for i, t in enumerate(texts):
        assert letters[i] == sum(c != " " for c in t)
        flat = squeeze(t) if t.strip() else t[:1]
        for j, lang in enumerate(model.languages):
            # The sample's last blank may be doubled by the blank between texts; either way it is one blank.
            assert got[i, j] == phrases(flat, folded[lang])


def test_hard_cases(spark, docs, empty):
    model = language.fit(docs)
    assert model.languages == ("de", "en", "fr", "ja")
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and got[2].score == 0.0
    assert got[0].lang_pred == "en" and got[7].lang_pred == "de" and got[12].lang_pred == "ja"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({2, 3, 4})
    none = language.fit(empty)
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = language.op8_language(spark, sf_dir).join(truth, "doc_id").filter("held_out").collect()
    assert len(rows) > 30 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_large_alphabet(spark):
    """A language of many hundred letters, beside one of few, keeps its clean texts; text of other letters goes."""
    rng = np.random.default_rng(5)
    letters = [chr(0x4E00 + 7 * i) for i in range(900)]
    words = ["".join(rng.choice(letters, 2)) for _ in range(2000)]
    many = lambda n: "".join(words[i] for i in rng.integers(0, len(words), n))
    few = lambda n: " ".join(rng.choice(["some", "plain", "short", "words", "again"], n))
    learned = spark.createDataFrame([(i, many(1000), "zh") for i in range(10)] + [(100 + i, few(40), "en") for i in range(10)], "doc_id long, text string, lang string")
    model = language.fit(learned)
    asked = spark.createDataFrame([(i, many(60), "zh") for i in range(20)] + [(100 + i, few(40), "en") for i in range(20)] + [(200, "".join(chr(0xAC00 + i) for i in range(100)), "ko")], "doc_id long, text string, lang string")
    assert {r.doc_id for r in language.accepted(asked, model).collect()} == set(range(20)) | set(range(100, 120))
    got = {r.doc_id: r.lang_pred for r in language.identify(asked, model).collect()}
    assert all(got[i] == "zh" and got[100 + i] == "en" for i in range(20))
    assert len(model.letters) > 700


def test_parses_like_substring_search_with_many_letters():
    rng = np.random.default_rng(6)
    letters = np.array([chr(0x4E00 + i) for i in range(600)])
    p = 1 / np.arange(1, 601)
    draw = lambda n: "".join(rng.choice(letters, n, p=p / p.sum()))
    samples = {"x": draw(3000), "y": draw(3000)}
    texts = [draw(200) for _ in range(20)] + [draw(3500), samples["x"] * 2, samples["x"][7:2900] + samples["y"] + chr(0xAC00) * 600, samples["x"][:1] * 2000]
    got, _ = language.Parser(language.model_of({k: [v] for k, v in samples.items()}, 10_000, 20_000)).phrases(texts)
    assert got.tolist() == [[phrases(t, samples["x"]), phrases(t, samples["y"])] for t in texts]


def test_null_texts_do_not_hide_a_language(spark):
    """Rows without text come first by their ids' hashes; the language is learned from the others all the same."""
    ids = [r.doc_id for r in spark.range(400).selectExpr("id AS doc_id").orderBy("doc_id").collect()]
    order = [r.doc_id for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").selectExpr("doc_id", "xxhash64(cast(doc_id AS string)) AS h").orderBy("h").collect()]
    rows = [(i, None if k % 3 else " 12 ", "fr") for k, i in enumerate(order[:200])] + [(order[-1], "bonjour le monde", "fr"), (order[-2], "hello you world", "en")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("en", "fr")


def test_score_by_brute_force(spark):
    learned = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "der hund lag auf dem boden", "de")], "doc_id long, text string, lang string")
    texts = ["the dog sat", "der hund sat on dem", "boden boden the", "q"]
    got = language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), language.fit(learned)).collect()
    for r in got:
        t = texts[r.doc_id]
        n = {k: phrases(t, v) for k, v in (("de", "der hund lag auf dem boden "), ("en", "the cat sat on the mat "))}
        odds = {k: (min(n.values()) / v) ** 8 for k, v in n.items()}
        assert r.lang_pred == min(n, key=lambda k: (n[k], k)) and abs(r.score - max(odds.values()) / sum(odds.values())) < 1e-9


def test_rows_share_the_characters_of_a_language():
    assert language.fair_cut([5, 100, 100], 65) == 30 and language.fair_cut([5, 6], 100) == 6 and language.fair_cut([], 9) == 0
    model = language.model_of({"x": ["a" * 1000, "the rest of it"]}, 100, 100)
    got, _ = language.Parser(model).phrases(["the rest of it"])
    assert got[0, 0] == 1


def test_many_labels(spark):
    """Of 1,500 labels each is learned, from its share of the letters; a bound keeps those with the most rows."""
    letters = [chr(0x4E00 + i) for i in range(1500)]
    rows = [(i, f"l{i:04d}", c * 30, None) for i, c in enumerate(letters)] + [(5000 + i, "l0007", letters[7] * 30, None) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, source string")
    model = language.fit(docs)
    assert len(model.languages) == 1500
    got = {r.doc_id: r.lang_pred for r in language.identify(docs.filter("doc_id IN (3, 700, 1499)"), model).collect()}
    assert got == {3: "l0003", 700: "l0700", 1499: "l1499"}
    few = language.fit(docs, most=2)
    assert few.languages == ("l0000", "l0007")


def test_short_texts_are_not_alien(spark):
    docs = spark.createDataFrame([(1, "en", "the quick brown fox and the dog " * 20), (2, None, "qzx" * 10), (3, None, "qzxvjk wpq zzk xqj " * 10)], "doc_id long, lang string, text string")
    model = language.fit(docs)
    kept = lambda **k: {r.doc_id for r in language.accepted(docs, model, **k).collect()}
    assert kept() == {1, 2} and kept(alien_chars=1) == {1} and kept(alien=9.0) == {1, 2, 3}

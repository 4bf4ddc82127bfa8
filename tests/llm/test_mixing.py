from collections import defaultdict

import pytest

from corpuskit.llm import mixing
from tests.llm.conftest import WORD


def fill(sizes, weights, most):
    """Targets by repeated resharing."""
    total = sum(sizes.values())
    capped = {}
    while True:
        free = [s for s in sizes if s not in capped]
        rest, w = total - sum(capped.values()), sum(weights[s] for s in free)
        over = [s for s in free if rest * weights[s] / w > most * sizes[s]]
        if not over:
            return {s: capped.get(s, rest * weights[s] / w if s not in capped else 0) for s in sizes}
        capped |= {s: most * sizes[s] for s in over}


def test_targets_and_takes(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    order = sorted(s for s in sizes if s is not None) + [None]
    want = fill(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, 3)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(r.size for r in rows if r.source == s) * 2
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))


def test_larger_budget_takes_a_superset(spark, docs):
    few = {r.doc_id: r.copies for r in mixing.mix(docs, weights=(1, 1, 5)).collect() if r.source == "c"}
    more = {r.doc_id: r.copies for r in mixing.mix(docs, weights=(1, 1, 9)).collect() if r.source == "c"}
    assert all(more[k] >= few[k] for k in few)


def test_documents_of_the_mix(spark, docs, empty):
    copies = {(r.doc_id, r.source): r.copies for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id, r.source] += 1
    for r in docs.collect():
        times = copies[r.doc_id, r.source] if WORD.search(r.text or "") else 1
        assert got[r.doc_id, r.source] in (times, 2 * times)  # doc 10 stands twice
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


@pytest.mark.parametrize("ids, texts", [((None,), 100), ((1, 2), 100), ((None,), 1), ((7,), 3)])
def test_ids_that_tell_nothing_apart(spark, tmp_path, ids, texts):
    """Sources whose rows have no id, or few: the mix comes as near to the target as with unique ids."""
    rows = [(ids[i % len(ids)], " ".join(["w"] * 10 + [f"t{i % texts}"] * (texts > 1)), s) for i in range(100) for s in "ab"]
    rows += [(i, "x y z " * 10, "c") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = mixing.mix(docs).collect()
    for s in "abc":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mixed_documents(docs).count() == sum(r.copies for r in got)


def test_budget_of_a_whole_source(spark):
    rows = [(1, "a", "x")] + [(i, "b b b b b b b b b b", "y") for i in range(2, 40)]
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1), (30, 1)).collect():
        assert r.source != "x" or abs(r.taken - r.target) <= 1

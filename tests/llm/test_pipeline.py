import corpus_pipeline
from corpuskit.llm.common import materialize


def test_stages(spark, docs, empty):
    """Each stage works on what its predecessor kept, and all but the last keep the columns."""
    frame, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, frame, ""), f"test-{name}")
        kept.append((name, out.columns == docs.columns, out.count()))
        frame = out
    assert [k[0] for k in kept] == ["language_id", "near_dedup", "substring_dedup", "source_mixing", "piece_encoding"]
    assert all(k[1] for k in kept[:-1]) and not kept[-1][1]
    assert kept[0][2] == docs.count() - 3 and kept[1][2] == kept[0][2] - 3  # docs without letters; copies of 0, 8 and 10
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0

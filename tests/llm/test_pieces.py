import random

import pytest
import sentencepiece

from corpuskit.llm import pieces
from tests.llm.conftest import ROWS

ODD = ["", "  a  b   c    ", "Hello   world\n é漢 😀 ", "\n\n x\n", "▁a▁▁b", " lead", "trail ", "a" * 50, "\x00\x01 z", "   ", " \n ", "日本語テキスト" * 30, "İi ß ẞ é̂", "\t\ttab\r\nline", None, "x" + " " * 37 + "y"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.default_model())


def test_equals_the_library(vocabulary, spark, sf_dir):
    rng = random.Random(1)
    texts = ODD + [r[1] for r in ROWS] + ["".join(rng.choice("abcdehilnorst ▁\n") for _ in range(rng.randrange(300))) for _ in range(150)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(100).collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    encoder = pieces.Encoder(vocabulary)
    tokens, at = encoder.encode(texts)
    data, ends = encoder.decode(tokens, at)
    for i, t in enumerate(texts):
        assert tokens[at[i] : at[i + 1]].tolist() == library.encode(t or "", num_threads=1)
        assert data[ends[i] : ends[i + 1]].tobytes().decode() == (t or "").replace("▁", " ")


def test_columns(spark, docs, empty):
    out = pieces.encode(docs.withColumnRenamed("node", "token_ids"), check=True)
    rows = out.collect()
    assert len(rows) == docs.count() and all(r.round_trip for r in rows)
    assert all((r.token_ids == []) == (not r.text) for r in rows)
    back = pieces.decode(out.select("doc_id", "text", "token_ids")).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert pieces.encode(empty).count() == 0


def test_clashing_columns(spark, docs):
    out = pieces.encode(docs.withColumnRenamed("node", "round_trip"))
    assert "round_trip" in out.columns and {r.round_trip for r in out.collect()} == {"q"}
    back = pieces.decode(out.withColumnRenamed("key", "decoded"))
    assert back.columns.count("decoded") == 1 and all(r.decoded == (r.text or "") for r in back.collect())
    assert [r.decoded for r in pieces.decode(spark.createDataFrame([(None,)], "token_ids array<int>")).collect()] == [""]

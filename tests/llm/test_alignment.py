import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpuskit.llm import alignment, pieces
from tests.llm.conftest import ROWS
from tests.llm.test_pieces import ODD

MORE = ["<|endoftext|> and <s> </s> <unk> <0x41>", " " * 2000 + "x", "\t" * 700, "日本語 😀😀 é̂  x　y", "ha" * 400, "\x7f\x00" * 30, "a▁b", "x" * 3000, " .;,|" * 50]


def brute(texts):
    """Straight from the definition: spans, groups, links and counts."""
    a = Tokenizer.from_file(alignment.default_bpe())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    letters = alignment.byte_letters()
    bytes_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, held = [], Counter()
    for text in texts:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if b"".join(map(bytes_a, x)) != want or b"".join(map(bytes_b, y)) != want:
            x, y = [], []
        groups, i, j = [], 0, 0
        while i < len(x):
            ga, gb, p, q = [], [], 0, 0
            while not ga or p != q:
                if p <= q:
                    ga.append(x[i])
                    p += len(bytes_a(x[i]))
                    i += 1
                else:
                    gb.append(y[j])
                    q += len(bytes_b(y[j]))
                    j += 1
            groups.append((ga, gb))
        links = Counter((s, t) for ga, gb in groups for s in ga for t in gb)
        held.update(links.keys())
        digest = hashlib.sha256(";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups).encode()).hexdigest() if groups else ""
        docs.append((len(x), len(y), len(groups), sum(links.values()), links, digest))
    top = Counter()
    for (s, _), n in held.items():
        top[s] = max(top[s], n)
    return [(n_a, n_b, n_g, n_l, sum(k for (s, t), k in links.items() if held[s, t] == top[s]), sum(k * held[p] for p, k in links.items()), digest) for n_a, n_b, n_g, n_l, links, digest in docs], held, top


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("slice_, block, pairs", [(1 << 20, 6 << 20, 1 << 22), (300, 500, 5)])
def test_brute_force(spark, tmp_path, monkeypatch, slice_, block, pairs):
    for name, value in (("SLICE", slice_), ("BLOCK", block), ("PAIRS", pairs)):
        monkeypatch.setattr(alignment, name, value)
    texts = ODD + MORE + [r[1] for r in ROWS] + MORE[:2]
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS block", "'p' AS pairs", "2 AS n").repartition(3).write.parquet(path)
    want, held, top = brute(texts)
    docs, counts = alignment.align(spark.read.parquet(path))
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in docs.collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert {(r.id_a, r.id_b): (r.n_docs, r.best) for r in counts.collect()} == {p: (n, n == top[p[0]]) for p, n in held.items()}


def test_whole_smallest_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute([r.text for r in docs])[0]
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in alignment.op12_alignment(spark, sf_dir).collect()}
    assert [got[r.doc_id] for r in docs] == want


def test_empty_and_null_ids(spark, docs, empty):
    assert alignment.align(empty)[0].count() == 0 and alignment.align(empty)[1].count() == 0
    out = alignment.align(docs)[0].collect()
    assert len(out) == docs.count()
    assert all((r.n_a == 0) == (r.groups_sha256 == "") == (r.n_links == 0) for r in out)


def test_slow_encoder_of_other_vocabularies(monkeypatch):
    with open(alignment.default_bpe(), encoding="utf-8") as f, open(pieces.default_model(), "rb") as g:
        tokens = alignment.Tokens(f.read(), g.read())
    assert tokens.fast is not None
    quick = [tokens.encode_a(" " + t) for t in ODD + MORE if t]
    tokens.fast = None
    assert quick == [tokens.encode_a(" " + t) for t in ODD + MORE if t]

"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a SentencePiece model (B) cover the same bytes.

Both tokenizers encode a blank and the text. Byte offsets where tokens of both end cut them into groups; every token
of A is linked with every token of B of its group. A pair of ids counts the documents that hold it linked.

Most groups are one token of each, whose bytes are then the same: an array made once from the vocabularies leads from
an id of A to the id of B with the same bytes (where B has a piece and a byte token of the same byte, to the piece).
Such identity pairs are counted in a vector as long as A's vocabulary, one a task. Only pairs of other groups are
shuffled, once a block of documents and not once a document, to be counted; their counts come back to the blocks that
hold them. What is known of all A ids, the counts of identity pairs and the highest count of each id, is as long as
the vocabulary and is sent to the tasks.

An encoded block is written once and read by the later passes, so no text is encoded twice.

Defined results: texts that are null or empty, and texts whose tokens do not give back blank and text in A or B
(U+2581 in a text, which B takes for a blank), have no tokens: zeros, and an empty ``groups_sha256``. The special
tokens' strings inside texts are plain text. Equal pairs in several groups of a document count once, each of their
links does. Repeated rows are documents of their own; null ids pass through; extra columns are ignored; texts are
encoded whole. Groups of any size give all their pairs: they are formed from the distinct ids of a group, a bounded
number at a time, so memory goes with the distinct pairs of a block, of ``BLOCK`` text bytes or one longer text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm.common import lean, materialize, text_bytes, text_slices
from corpuskit.llm.pieces import default_model, ragged

#: Text bytes that are encoded at once and that a block has, about; pairs that are formed at once.
SLICE, BLOCK, PAIRS = 1 << 20, 6 << 20, 1 << 22
#: Texts with longer runs of white space go to the slower of A's encoders: the other one looks at runs by recursion.
LONG_BLANK = 512
_BLANKS = re.compile(r"\s{%d}" % LONG_BLANK)


def default_bpe() -> str:
    import public_tokenizers  # the package that comes with the vocabulary files

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the other
    bytes for the letters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokens:
    """Both tokenizers of a task, their tokens' bytes, and the identity map."""

    def __init__(self, bpe_json: str, piece_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.slow = Tokenizer.from_str(bpe_json)
        self.slow.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        description = json.loads(bpe_json)
        letters, vocabulary = byte_letters(), description["model"]["vocab"]
        special = {t["content"] for t in description["added_tokens"]}
        a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if token not in special:
                a[i] = bytes(letters[c] for c in token)
        p = self.pieces
        b = [b"" if p.is_control(i) or p.is_unknown(i) else bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())]
        self.bytes_a, self.bytes_b = a, b
        self.n_a, self.n_b = len(a), len(b)
        self.size_a, self.size_b = (np.array([len(x) for x in v], dtype=np.int64) for v in (a, b))
        by_bytes: dict[bytes, int] = {}
        for byte_token in (True, False):  # pieces come last, and stay
            by_bytes.update((x, i) for i, x in enumerate(b) if x and p.is_byte(i) is byte_token)
        self.same = np.array([by_bytes.get(x, -1) if x else -1 for x in a], dtype=np.int64)
        self.fast = self._fast(description, a)
        self.raw_a, self.raw_b = (np.frombuffer(b"".join(v), dtype=np.uint8) for v in (a, b))
        self.at_a, self.at_b = (np.concatenate(([0], np.cumsum(s))) for s in (self.size_a, self.size_b))
        # The id as text behind each of the four marks that may stand before it.
        n = max(self.n_a, self.n_b)
        named = [f"{mark}{i}".encode() for mark in ("", ",", "|", ";") for i in range(n)]
        self.named, self.named_n = np.frombuffer(b"".join(named), dtype=np.uint8), n
        self.named_at = np.concatenate(([0], np.cumsum([len(x) for x in named])))

    @staticmethod
    def _fast(description: dict, a: list[bytes]):
        """A's vocabulary as ranks, if its merges come in the order of its ids; else none."""
        import tiktoken

        vocabulary, merges = description["model"]["vocab"], description["model"]["merges"]
        made = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in merges]
        if made != list(range(256, 256 + len(merges))) or not description["pre_tokenizer"].get("use_regex") or description["normalizer"]:
            return None
        # How byte-level pre-tokenizing splits a text: a fixed value.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={x: i for i, x in enumerate(a) if x}, special_tokens={})

    def encode_a(self, text: str) -> list[int]:
        if self.fast is None or _BLANKS.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encoded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of all texts end to end, and the place of each text's first with the end; texts without tokens have none."""
        texts = [t if t else None for t in column.to_pylist()]
        live = [i for i, t in enumerate(texts) if t]
        a = [self.encode_a(" " + texts[i]) for i in live]
        b = self.pieces.encode([texts[i] for i in live], num_threads=1)
        data, offsets = text_bytes(column)
        for k, i in enumerate(live):
            x, y = (np.array(v[k], dtype=np.int64) for v in (a, b))
            want = np.concatenate((np.array([32], np.uint8), data[offsets[i] : offsets[i + 1]]))
            a[k], b[k] = (x, y) if all(np.array_equal(ragged(raw, at, v)[0], want) for raw, at, v in ((self.raw_a, self.at_a, x), (self.raw_b, self.at_b, y))) else (x[:0], y[:0])
        out = []
        for v in (a, b):
            sizes = np.zeros(len(texts), dtype=np.int64)
            sizes[live] = [len(x) for x in v]
            out += [np.concatenate([np.zeros(0, np.int64), *v]), np.concatenate(([0], np.cumsum(sizes)))]
        return out[0], out[1], out[2], out[3]


class Groups:
    """The groups of a run of texts: group of each token, its document, and what it holds."""

    def __init__(self, tokens: Tokens, column: pa.Array):
        self.tokens = tokens
        self.a, self.at_a, self.b, self.at_b = tokens.encoded(column)
        end_a, end_b = np.cumsum(tokens.size_a[self.a]), np.cumsum(tokens.size_b[self.b])
        n = int(end_a[-1]) if len(end_a) else 0
        both = np.zeros(n + 1, dtype=bool)
        both[end_a] = True
        mark = np.zeros(n + 1, dtype=bool)
        mark[end_b] = True
        ends = np.flatnonzero(both & mark)
        self.group_a, self.group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        self.n_a, self.n_b = np.bincount(self.group_a, minlength=len(ends)), np.bincount(self.group_b, minlength=len(ends))
        docs = len(self.at_a) - 1
        doc_a = np.repeat(np.arange(docs), np.diff(self.at_a))
        self.doc = np.zeros(len(ends), dtype=np.int64)
        self.doc[self.group_a] = doc_a
        self.edges = np.searchsorted(self.doc, np.arange(docs + 1))

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
        return sums[self.edges[1:]] - sums[self.edges[:-1]]

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups written out; empty without tokens."""
        place = np.concatenate((self.group_a * 2, self.group_b * 2 + 1))
        first = lambda g: np.concatenate((np.ones(min(1, len(g)), bool), g[1:] != g[:-1]))
        firsts_a, firsts_b = first(self.group_a), first(self.group_b)
        opens = np.zeros(len(self.a), dtype=bool)
        opens[self.at_a[:-1][np.diff(self.at_a) > 0]] = True
        mark = np.concatenate((np.where(opens, 0, np.where(firsts_a, 3, 1)), np.where(firsts_b, 2, 1)))
        name = mark * self.tokens.named_n + np.concatenate((self.a, self.b))
        order = np.argsort(place, kind="stable")
        text, sizes = ragged(self.tokens.named, self.tokens.named_at, name[order])
        ends = np.concatenate(([0], np.cumsum(sizes)))[self.at_a + self.at_b]
        data = text.tobytes()
        return [hashlib.sha256(data[i:j]).hexdigest() if i < j else "" for i, j in zip(ends[:-1], ends[1:], strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair (A id times B's size plus B id) and links of each pair that a document holds, in order."""
        n = self.tokens.n_b
        one = (self.n_a == 1) & (self.n_b == 1)
        single_a = self.a[one[self.group_a]]
        found = [(self.doc[one], single_a * n + self.b[one[self.group_b]], np.ones(len(single_a), np.int64))]
        ga, ta, ma = self._distinct(self.group_a, self.a, ~one)
        gb, tb, mb = self._distinct(self.group_b, self.b, ~one)
        many = np.flatnonzero(~one)
        a_at, b_at = np.searchsorted(ga, many), np.searchsorted(gb, many)
        a_n, b_n = np.searchsorted(ga, many, "right") - a_at, np.searchsorted(gb, many, "right") - b_at
        # One row for each A id of a group, which meets all B ids of it.
        row_of = np.repeat(np.arange(len(many)), a_n)
        meets = b_n[row_of]
        cuts = np.cumsum(meets)
        lo = 0
        while lo < len(meets):
            done = int(cuts[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(cuts, done + PAIRS, side="right")))
            rows = np.arange(lo, hi)
            left = np.repeat(rows, meets[rows])
            right = np.arange(len(left)) - np.repeat(np.cumsum(meets[rows]) - meets[rows], meets[rows]) + np.repeat(b_at[row_of[rows]], meets[rows])
            found.append(_summed(self.doc[many[row_of[left]]], ta[left] * n + tb[right], ma[left] * mb[right]))
            lo = hi
        return _summed(*(np.concatenate(x) for x in zip(*found, strict=True)))

    @staticmethod
    def _distinct(group: np.ndarray, token: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keep = wanted[group]
        return _summed(group[keep], token[keep], np.ones(int(keep.sum()), np.int64))


def _summed(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (first, second) in order, and the sums of ``n``."""
    order = np.lexsort((second, first))
    first, second, n = first[order], second[order], n[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(first)), bool), (first[1:] != first[:-1]) | (second[1:] != second[:-1]))))
    return first[new], second[new], np.add.reduceat(n, new) if len(new) else n[:0]


_DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"


def encoded(docs: DataFrame, bpe_json: str, piece_model: bytes) -> DataFrame:
    """``block, doc_id`` and what a document's tokens give by themselves, with its pairs and their links."""
    shared = docs.sparkSession.sparkContext.broadcast((bpe_json, piece_model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, block, room = Tokens(*shared.value), None, 0
        for batch in batches:
            for at, part in text_slices(batch.column(2), SLICE):
                if block is None or room <= 0:
                    block, room = batch.column(0)[at].as_py(), BLOCK
                room -= part.nbytes
                g = Groups(tokens, part)
                doc, pair, links = g.pairs()
                places = np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(places), pa.array(x)) for x in (pair, links)]
                counts = [pa.array(x.astype(np.int64)) for x in (np.diff(g.at_a), np.diff(g.at_b), np.diff(g.edges), g.per_doc(g.n_a * g.n_b))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), batch.column(1).slice(at, len(part)), *counts, pa.array(g.digests(), pa.string()), *lists], ["block", "doc_id", *(f.split()[0] for f in _DOC.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(lean(run), f"block long, doc_id {kind}, {_DOC}")


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def pair_counts(blocks: DataFrame, same: np.ndarray, n_b: int) -> DataFrame:
    """``block, pair, n``: documents of the block that hold the pair; identity pairs come once a task, without a block."""
    shared = blocks.sparkSession.sparkContext.broadcast(same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = shared.value
        identity, block, held = np.zeros(len(same), dtype=np.int64), None, []

        def rows(block, pair, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block] * len(pair), pa.int64()), pa.array(pair), pa.array(n)], ["block", "pair", "n"])

        def leave() -> Iterator[pa.RecordBatch]:
            if held:
                yield rows(block, *np.unique(np.concatenate(held), return_counts=True))
                held.clear()

        for batch in batches:
            at = batch.column(0).to_numpy()
            for run_of in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1) if len(at) else ():
                if at[run_of[0]] != block:
                    yield from leave()
                    block = int(at[run_of[0]])
                pair = _flat(batch.column(1).slice(int(run_of[0]), len(run_of)))
                plain = same[pair // n_b] == pair % n_b
                identity += np.bincount(pair[plain] // n_b, minlength=len(same))
                held.append(pair[~plain])
        yield from leave()
        some = np.flatnonzero(identity)
        yield rows(None, some * n_b + same[some], identity[some])

    return blocks.select("block", "pairs").mapInArrow(lean(run), "block long, pair long, n long")


def align(docs: DataFrame, bpe_file: str | None = None, model_file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A row for each row of ``docs`` (doc_id, text), and ``id_a, id_b, n_docs, best`` of all pairs of ids.

    The first has ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, pairs, links``: a pair is an
    A id times the size of B's vocabulary plus a B id, ``links`` how often the document has it."""
    spark = docs.sparkSession
    with open(bpe_file or default_bpe(), encoding="utf-8") as f, open(model_file or default_model(), "rb") as g:
        bpe_json, piece_model = f.read(), g.read()
    tokens = Tokens(bpe_json, piece_model)
    same, n_a, n_b = tokens.same, tokens.n_a, tokens.n_b
    blocks = materialize(encoded(docs, bpe_json, piece_model), "encoded")
    held = materialize(pair_counts(blocks, same, n_b), "pairs")
    counts = materialize(held.groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    best = counts.groupBy(F.floor(F.col("pair") / n_b).alias("a")).agg(F.max("n").alias("n"))
    # A number for each id of A, at most: the highest counts, and those of the identity pairs.
    highest, identity = np.zeros(n_a, dtype=np.int64), np.zeros(n_a, dtype=np.int64)
    for a, n in best.toLocalIterator():
        highest[a] = n
    for pair, n in held.filter(F.col("block").isNull()).groupBy("pair").agg(F.sum("n")).toLocalIterator():
        identity[pair // n_b] = n
    shared = spark.sparkContext.broadcast((same, highest, identity))
    back = held.filter(F.col("block").isNotNull()).select("block", "pair").join(counts, "pair").select("block", "pair", "n")
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = [c for c in blocks.columns if c != "block"]

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        same, highest, identity = shared.value
        key, n = right.column("pair").to_numpy(), right.column("n").to_numpy()
        order = np.argsort(key)
        key, n = np.append(key[order], -1), np.append(n[order], 0)
        lists = left.column("pairs").combine_chunks()
        pair, links = _flat(lists), _flat(left.column("links").combine_chunks())
        edges = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        a = pair // n_b
        plain = same[a] == pair % n_b
        counted = np.where(plain, identity[a], n[np.searchsorted(key[:-1], pair)])
        per_doc = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[edges]).astype(np.int64)
        return left.select(columns).append_column("n_best", pa.array(per_doc(np.where(counted == highest[a], links, 0)))).append_column("count_sum", pa.array(per_doc(links * counted)))

    out = blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(count, f"doc_id {kind}, {_DOC}, n_best long, count_sum long")
    ids = F.floor(F.col("pair") / n_b).cast("long")
    known = F.broadcast(best.withColumnRenamed("n", "best"))  # a row for each id of A, at most
    pairs = counts.join(known, ids == F.col("a")).select(ids.alias("id_a"), (F.col("pair") % n_b).alias("id_b"), F.col("n").alias("n_docs"), (F.col("n") == F.col("best")).alias("best"))
    return out, pairs


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return docs.select(F.col("doc_id").cast("long"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

"""The inverted index: positional postings by term, item and field, with the statistics that ranking needs.

A posting holds the places of its term in the field, in order, and the length of its item, so that ranking and phrases
need no other table by item. Items are tokenised where they are read: the tokens of one item never leave its task, and
a posting is made whole there. ``lead`` marks one posting of each (term, item), so the number of items of a term is a
plain count. Ids are unique, and so are the fields of an id."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import tokenize

#: The indexed fields and their weights in ranking.
FIELD_WEIGHTS = {
    "title": 8.0,
    "retrieval_hints": 6.0,
    "topics": 4.0,
    "entities": 4.0,
    "understanding": 3.0,
    "why_useful": 3.0,
    "vision_text": 3.0,
    "meta_text": 2.0,
    "extracted_text": 1.0,
    "domain": 2.0,
    "kind": 2.0,
}


#: Tokens that are grouped into postings at once, up to the end of an item; a piece without any counts as one.
TOKENS_AT_ONCE = 500_000
#: Tokens of a field that come to Python as one row, so that a batch of rows is bounded however long texts are.
PIECE = 256
#: The postings of a term in some items, list by list: the number of the field (-1 beside the length of an item), how many
#: places and where they begin among ``positions``, which holds those of all.
BLOCK = "ids fields tf starts n_tokens lead positions".split()
FIELD_NUMBER = {f: i for i, f in enumerate(FIELD_WEIGHTS)}
POSTING = "term, id, field, tf, positions, n_tokens, lead".split(", ")


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # term, id, field, tf, positions, n_tokens, lead; bucket where stored
    doc_stats: DataFrame  # id, n_tokens
    term_stats: DataFrame  # term, df; bucket where stored
    totals: DataFrame  # one row: n_docs, avg_tokens
    buckets: int | None = None  # of terms, where stored
    parts: DataFrame | None = None  # id, field, parts: each token with what stands behind it, where stored


def item_fields(items: DataFrame) -> DataFrame:
    """``id, fields``: of each live item the fields that it has (field, text); list fields are joined by blanks, the
    values of a map by blanks in the order of its keys."""
    kinds = dict(items.dtypes)

    def as_text(field: str) -> Column:
        c = F.col(field)
        if kinds[field].startswith("map"):
            return F.array_join(F.transform(F.array_sort(F.map_keys(c)), lambda k: F.element_at(c, k)), " ")
        return F.array_join(c, " ") if kinds[field].startswith("array") else c.cast("string")

    present = [f for f in FIELD_WEIGHTS if f in kinds]
    live = items.filter(~F.coalesce("deleted", F.lit(False))) if "deleted" in kinds else items
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), as_text(f).alias("text")) for f in present])
    return live.select("id", F.filter(pairs, lambda p: p["text"].isNotNull()).alias("fields"))


def index_docs(items: DataFrame) -> DataFrame:
    """``id, field, text`` of each live item and field that it has."""
    return item_fields(items).select("id", F.explode("fields").alias("f")).select("id", "f.field", "f.text")


def gathered(docs: DataFrame) -> DataFrame:
    """``id, fields`` of ``docs`` (id, field, text)."""
    return docs.groupBy("id").agg(F.collect_list(F.struct("field", "text")).alias("fields"))


def positions(docs: DataFrame) -> DataFrame:
    """``id, field, pos, term``: every token of every field."""
    return docs.select("id", "field", F.posexplode(tokenize(F.col("text"))).alias("pos", "term"))


def _grouped(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The postings of some whole items (rows of ``pieces_of``) in blocks by term; for each item one without a term, its
    length."""
    all_ = pa.Table.from_batches(pieces).combine_chunks()
    ids, no, name, at, lists = (c.combine_chunks() for c in all_.columns)
    begins_field = at.to_numpy() == 0
    begins = begins_field & (no.to_numpy() == 0)
    ids, name = ids.filter(pa.array(begins)), name.filter(pa.array(begins_field)).dictionary_encode()
    piece_row = np.cumsum(begins, dtype=np.int32) - np.int32(1)
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    m = len(ids)
    row = np.repeat(piece_row, sizes)
    of = np.repeat(np.cumsum(begins_field, dtype=np.int32) - np.int32(1), sizes)
    place = np.arange(len(of), dtype=np.int32) + np.repeat((at.to_numpy() - np.cumsum(sizes) + sizes).astype(np.int32), sizes)
    length = np.bincount(piece_row, sizes, minlength=m).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    code = words.indices.to_numpy()
    order = np.argsort(code, kind="stable")  # tokens come by item, field and place already
    code, of, row, place = code[order], of[order], row[order], place[order]
    fresh = np.ones(len(code), dtype=bool)
    fresh[1:] = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(fresh)
    lead = np.ones(len(at), dtype=bool)
    lead[1:] = (code[at][1:] != code[at][:-1]) | (row[at][1:] != row[at][:-1])
    n = len(at)
    # Postings of one term side by side are a block; the lengths of all items are one more, without a term.
    term = code[at]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, n), bool), term[1:] != term[:-1])))
    items = np.add.reduceat(lead, first, dtype=np.int64) if n else np.zeros(0, np.int64)
    edges = pa.array(np.concatenate((first, [n, n + m])).astype(np.int32))
    none = np.zeros(m, np.int32)
    numbers = np.array([FIELD_NUMBER[f] for f in name.dictionary.to_pylist()], np.int8)[name.indices.to_numpy()]
    column = lambda *parts: pa.ListArray.from_arrays(edges, pa.array(np.concatenate(parts)))
    block = pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(edges, ids.take(pa.array(np.concatenate((row[at], np.arange(m)))))),
            column(numbers[of[at]], np.full(m, -1, np.int8)),
            column(np.diff(np.append(at, len(code))).astype(np.int32), length.astype(np.int32)),
            column((at - np.repeat(at[first], np.diff(np.append(first, n)))).astype(np.int32), none),
            column(length[row[at]].astype(np.int32), length.astype(np.int32)),
            column(lead, none.astype(bool)),
            pa.ListArray.from_arrays(pa.array(np.append(at[first], [len(code)] * 2).astype(np.int32)), pa.array(place.astype(np.int32))),
        ],
        BLOCK,
    )
    names = pa.concat_arrays([words.dictionary.take(pa.array(term[first])), pa.nulls(1, words.dictionary.type)])
    return pa.RecordBatch.from_arrays([names, pa.array(np.append(items, 0)), block], ["term", "n_items", "block"])


def unpacked(blocks: DataFrame) -> DataFrame:
    """A row for each posting of ``blocks``, other columns than the number of items as they were."""
    kept = [c for c in blocks.columns if c not in ("n_items", "block")]
    one = F.arrays_zip(*[F.col(f"block.{c}").alias(c) for c in BLOCK[:-1]])
    rows = blocks.select(*kept, F.col("block.positions").alias("_places"), F.explode(one).alias("p"))
    field = F.get(F.array(*map(F.lit, FIELD_WEIGHTS)), F.col("p.fields").cast("int"))
    places = F.slice("_places", F.col("p.starts") + 1, F.when(field.isNull(), 0).otherwise(F.col("p.tf")))
    return rows.select(*kept, F.col("p.ids").alias("id"), field.alias("field"), F.col("p.tf").cast("long").alias("tf"), places.alias("positions"), F.col("p.n_tokens").cast("long").alias("n_tokens"), F.col("p.lead").alias("lead"))


def postings_of(fields: DataFrame) -> DataFrame:
    """Postings of ``id, fields``; and for each item a row without term, whose ``tf`` is the item's length."""
    return unpacked(blocks_of(fields))


def pieces_of(fields: DataFrame) -> DataFrame:
    """``id, no, field, at, tokens``: the tokens of ``id, fields`` in rows of at most ``PIECE``, in order: of the field
    ``no`` of the item those from ``at`` on. A field without tokens is a row, and so is an item without fields (its field
    stands for none)."""
    one = fields.select("id", F.posexplode_outer("fields").alias("no", "f"))
    cut = one.select("id", F.coalesce("no", F.lit(0)).alias("no"), F.coalesce("f.field", F.lit("title")).alias("field"), tokenize(F.col("f.text")).alias("tokens"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1, F.lit(0)), F.lit(PIECE))
    each = cut.select("id", "no", "field", F.explode(F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice("tokens", i + 1, PIECE).alias("tokens")))).alias("p"))
    return each.select("id", "no", "field", "p.at", "p.tokens")


def blocks_of(fields: DataFrame) -> DataFrame:
    """``term, n_items, block``: the same by term for some items at a time, with how many of them have it.

    Python holds ``TOKENS_AT_ONCE``, what is left of an item, and a batch of pieces: no more for more or longer texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            upto = np.append(0, np.cumsum(np.maximum(batch.column("tokens").value_lengths().to_numpy(), 1)))
            lo = 0
            for begin in np.flatnonzero((batch.column("at").to_numpy() == 0) & (batch.column("no").to_numpy() == 0)):
                if size + upto[begin] - upto[lo] >= TOKENS_AT_ONCE:
                    yield _grouped([*held, batch.slice(lo, begin - lo)])
                    held, size, lo = [], 0, begin
            held.append(batch.slice(lo))
            size += upto[-1] - upto[lo]
        if size:
            yield _grouped(held)

    kind = fields.schema["id"].dataType.simpleString()
    schema = f"term string, n_items long, block struct<ids: array<{kind}>, fields: array<tinyint>, tf: array<int>, starts: array<int>, n_tokens: array<int>, lead: array<boolean>, positions: array<int>>"
    return pieces_of(fields).mapInArrow(run, schema)


def parts_of(fields: DataFrame) -> DataFrame:
    """``id, field, parts``: each token of a field as it is written, with the characters up to the next one. What stands
    before the first token is left out. (A dotted capital I is taken apart first, as its small letter is.)"""
    text = F.replace(F.col("f.text"), F.lit("\u0130"), F.lit("i\u0307"))
    pattern = F.lit(r"([\p{L}\p{N}]+[^\p{L}\p{N}]*)")
    return fields.select("id", F.explode("fields").alias("f")).select("id", "f.field", F.regexp_extract_all(text, pattern, F.lit(1)).alias("parts"))


def totals_of(doc_stats: DataFrame) -> DataFrame:
    return doc_stats.agg(F.count("*").alias("n_docs"), (F.sum("n_tokens") / F.count("*")).alias("avg_tokens"))


def term_stats_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count_if("lead").alias("df"))


def index_of(raw: DataFrame) -> Index:
    """The index of the rows of ``postings_of``."""
    doc_stats = raw.filter("term IS NULL").select("id", F.col("tf").alias("n_tokens"))
    postings = raw.filter("term IS NOT NULL")
    return Index(postings, doc_stats, term_stats_of(postings), totals_of(doc_stats))


def build_index(docs: DataFrame) -> Index:
    """The index as one plan of ``docs`` (id, field, text). Searches want it written first:
    ``sources.tables.stored_index``."""
    return index_of(postings_of(gathered(docs)))


def merge_index(index: Index, changed: DataFrame) -> Index:
    """The index after ``changed`` (id, field, text) replaced all fields of its ids; items without rows there stay."""
    ids = changed.select("id").distinct()
    fresh = build_index(changed)
    postings = index.postings.join(ids, "id", "left_anti").select(*POSTING).unionByName(fresh.postings)
    doc_stats = index.doc_stats.join(ids, "id", "left_anti").unionByName(fresh.doc_stats)
    gone = index.postings.join(ids, "id", "left_semi").groupBy("term").agg((-F.count_if("lead")).alias("df"))
    term_stats = index.term_stats.select("term", "df").unionByName(gone).unionByName(fresh.term_stats).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    return Index(postings, doc_stats, term_stats, totals_of(doc_stats))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def pruned(index: Index, terms: DataFrame) -> Index:
    """The index with the postings and statistics of the buckets of ``terms`` (term) only; the driver gets the numbers
    of these buckets. An index that is not stored comes back as it is."""
    if index.buckets is None:
        return index
    asked = sorted(r[0] for r in terms.select(bucket_of(F.col("term"), index.buckets)).distinct().toLocalIterator())
    keep = F.col("bucket").isin(asked) if asked else F.lit(False)
    return Index(index.postings.filter(keep), index.doc_stats, index.term_stats.filter(keep), index.totals, index.buckets, index.parts)

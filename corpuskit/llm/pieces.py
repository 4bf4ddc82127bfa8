"""SentencePiece encoding and decoding (BPE with byte fallback) over a suffix array of each batch's text.

The texts of a batch are cut into units that no merge crosses (a word with the blanks before it, or a line break);
each distinct unit is encoded once. Their text is laid end to end and its suffixes are sorted to the depth that
pieces need. Every piece of the vocabulary is looked up by binary search; its range of suffixes are its occurrences,
and each occurrence is an edge from its first to its last character. Edges are sorted by where they end, and one pass
over the positions of all units relaxes them: the last piece of the encoding of each prefix is the one edge whose
piece may follow the last piece of the prefix before it. Two pieces may stand side by side if merging by score, left
to right among equals, never joins across their border; that is decided from the merges that made them.

Runs of blanks are no matter of positions, since the pieces of blanks all have one score: units that begin with two
are merged step by step.

Defined results: a null or empty text has no tokens; U+2581 in a text is a blank, as the model has it, so it decodes
to one; texts are encoded whole; repeated rows give repeated results; null ids decode to an empty text; other columns
pass through ``encode`` and ``decode``, but those named like the ones that they add are replaced.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm.common import lean, mix64, text_slices

BLANK = "▁"
#: Bytes of unit text that are indexed at once, units that a task remembers, and bytes of text that it encodes at once.
CHUNK, REMEMBER, BATCH = 1 << 17, 100_000, 1 << 20
_UNIT = re.compile(r"\n| *[^ \n]+| +")
_MARK = 0xFF  # stands for the blank mark in the index: no UTF-8 text has this byte


def default_model() -> str:
    """The model that comes with the vocabulary files of the machine, of which ``public_tokenizers`` tells the place."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """What encoding needs of a model: pieces, the order of merges, how each piece is merged, and the byte pieces.

    Its size is that of the vocabulary, so it is sent to the tasks with their code."""

    def __init__(self, model_file: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = m.get_piece_size()
        special = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i) for i in range(n)]
        self.size = n
        self.piece = [m.id_to_piece(i) for i in range(n)]
        self.id_of = {p: i for i, p in enumerate(self.piece) if not special[i]}
        self.score = [m.get_score(i) for i in range(n)]
        self.byte_id = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.id_of):
            raise ValueError("a piece of this model crosses the border of units")
        # Merges in their order: better scores first. Equal scores occur only among runs of blanks, which plain() does.
        prio = np.zeros(n + 2, dtype=np.int32)
        left = np.arange(n + 2, dtype=np.int32)
        right = np.arange(n + 2, dtype=np.int32)
        whole, scores = [], set()
        for p, i in self.id_of.items():
            parts, merges = self.plain(p)
            if parts != [i]:
                continue
            if not p.startswith(BLANK * 2):
                whole.append(i)
                if len(p) > 1:
                    if self.score[i] in scores:
                        raise ValueError("two pieces of this model have one score")
                    scores.add(self.score[i])
                    left[i], right[i] = merges[-1]
        order = sorted((i for i in whole if len(self.piece[i]) > 1), key=lambda i: -self.score[i])
        prio[order] = np.arange(1, len(order) + 1)
        keys, made = [], []
        for i in order:
            p = self.piece[i]
            for cut in range(1, len(p)):
                a, b = self.id_of.get(p[:cut]), self.id_of.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(prio[i])
        at = np.argsort(keys)
        self.pair_keys, self.pair_prio = np.array(keys, dtype=np.int64)[at], np.array(made, dtype=np.int32)[at]
        self.prio, self.left, self.right = prio, left, right
        self.unknown, self.start = n, n + 1  # a character without a piece; the place before a unit
        coded = sorted((self._bytes(self.piece[i]), i) for i in whole)
        self.coded = [c for c, _ in coded]
        self.coded_id = np.array([i for _, i in coded], dtype=np.int32)
        self.coded_len = np.array([len(c) for c in self.coded], dtype=np.int32)
        self.one_char = np.array([len(self.piece[i]) == 1 for i in self.coded_id])
        out = [b"" if s else p.replace(BLANK, " ").encode() for p, s in zip(self.piece, special, strict=True)]
        for b, i in enumerate(self.byte_id):
            out[i] = bytes([b])
        self.out_bytes = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.out_at = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)

    @staticmethod
    def _bytes(text: str) -> bytes:
        return text.encode().replace(BLANK.encode(), bytes([_MARK]))

    def plain(self, unit: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Merging step by step: the piece ids of a string with blank marks (bytes for unknown characters), and the pairs merged."""
        symbols: list[str | None] = list(unit)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(symbols) and (k := self.id_of.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (-self.score[k], i, j, len(symbols[i]) + len(symbols[j])))

        for i in range(len(symbols) - 1):
            offer(i)
        merges = []
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or after[i] != j or len(symbols[i]) + len(symbols[j]) != size:
                continue
            merges.append((self.id_of.get(symbols[i], -1), self.id_of.get(symbols[j], -1)))
            symbols[i] += symbols[j]
            symbols[j] = None
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        ids = []
        for s in symbols:
            if s is not None:
                k = self.id_of.get(s)
                ids.extend([k] if k is not None else self.byte_id[list(s.encode())].tolist())
        return ids, merges


class Encoder:
    """Encodes and decodes batches of texts; remembers the units it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pairs = np.full(1 << 20, -1, dtype=np.int64)  # direct-mapped memory of pairs and whether they may touch
        self.touch = np.zeros(1 << 20, dtype=bool)
        coded = vocabulary.coded
        pad = lambda c, fill: int.from_bytes(c[:8].ljust(8, fill), "big")
        self.low = np.array([pad(c, b"\x00") for c in coded], dtype=np.uint64)
        self.high = np.array([pad(c, b"\xff") for c in coded], dtype=np.uint64)
        self.long = np.flatnonzero(vocabulary.coded_len > 8)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.tokens = np.zeros(0, dtype=np.int32)
        self.at = np.zeros(1, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids end to end, and the place of each text's first with the end."""
        if len(self.known) > REMEMBER:
            self._forget()
        known, fresh, order, counts = self.known, [], [], []
        for text in texts:
            units = _UNIT.findall(" " + text.replace(BLANK, " ")) if text else ()
            counts.append(len(units))
            for u in units:
                k = known.get(u)
                if k is None:
                    k = known[u] = len(known)
                    fresh.append(u)
                order.append(k)
        self._learn(fresh)
        order = np.array(order, dtype=np.int64)
        out, sizes = ragged(self.tokens, self.at, order)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return out, ends[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)]

    def decode(self, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of token lists end to end, and the offsets; the blank that stands before each text is dropped."""
        out, sizes = ragged(self.v.out_bytes, self.v.out_at, tokens.astype(np.int64))
        ends = np.concatenate(([0], np.cumsum(sizes)))[at]
        firsts = ends[:-1][ends[:-1] < ends[1:]]
        firsts = firsts[out[firsts] == 32]
        keep = np.ones(len(out), dtype=bool)
        keep[firsts] = False
        kept = np.concatenate(([0], np.cumsum(keep)))
        return out[keep], kept[ends]

    def _learn(self, units: list[str]) -> None:
        made, sizes, at = [self.tokens], [np.diff(self.at)], 0
        while at < len(units):
            to, room = at, CHUNK
            while to < len(units) and (to == at or room > 0):
                room -= len(units[to]) + 1
                to += 1
            tokens, size = self._chunk(units[at:to])
            made.append(tokens)
            sizes.append(size)
            at = to
        self.tokens = np.concatenate(made)
        self.at = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int64)

    def _chunk(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the units end to end, and how many each has."""
        v = self.v
        plain = {i: v.plain(u.replace(" ", BLANK))[0] for i, u in enumerate(units) if u.startswith("  ")}
        data = pa.array(["" if i in plain else u for i, u in enumerate(units)], pa.large_string())
        offsets = np.frombuffer(data.buffers()[1], dtype=np.int64)[: len(units) + 1]
        sizes = np.diff(offsets)
        raw = np.frombuffer(data.buffers()[2], dtype=np.uint8)[: offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
        begin = offsets[:-1] + np.arange(len(units))  # one byte 0 after each unit
        text = np.zeros(len(raw) + len(units) + 16, dtype=np.uint8)
        unit_of = np.repeat(np.arange(len(units)), sizes)
        text[np.arange(len(raw)) + unit_of] = np.where(raw == 32, _MARK, raw)
        start, end, piece = self._edges(text, begin, sizes)
        unit = np.searchsorted(begin, start, side="right") - 1
        rel = end - begin[unit]
        order = np.argsort((rel << 40) | (unit << 9) | (511 - np.minimum(end - start, 511)), kind="stable")
        start, end, piece, unit, rel = (x[order] for x in (start, end, piece, unit, rel))
        last = np.full(len(text), -1, dtype=np.int32)
        back = np.zeros(len(text), dtype=np.int64)
        last[begin] = v.start
        steps = np.flatnonzero(np.concatenate(([True], rel[1:] != rel[:-1]))) if len(rel) else np.zeros(0, np.int64)
        group_end = np.concatenate((np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)])) if len(unit) else np.zeros(1, np.int64)
        for lo, hi in zip(steps, np.append(steps[1:], len(rel)), strict=True):
            firsts = lo + np.flatnonzero(np.concatenate(([True], unit[lo + 1 : hi] != unit[lo : hi - 1])))
            ends = np.minimum(group_end[np.searchsorted(group_end, firsts, side="right")], hi)
            todo = firsts
            while len(todo):
                ok = self._may_follow(last[start[todo]], piece[todo])
                good = todo[ok]
                last[end[good]] = piece[good]
                back[end[good]] = start[good]
                todo, ends = todo[~ok] + 1, ends[~ok]
                more = todo < ends
                todo, ends = todo[more], ends[more]
        return self._walk(units, plain, begin, sizes, last, back, text)

    def _walk(self, units, plain, begin, sizes, last, back, text) -> tuple[np.ndarray, np.ndarray]:
        """Tokens read from the ends of the units back to their starts."""
        v = self.v
        at = begin + sizes
        lanes = np.flatnonzero(sizes > 0)
        lost = lanes[last[at[lanes]] < 0]
        for i in lost:
            plain[int(i)] = v.plain(units[i].replace(" ", BLANK))[0]
        lanes = lanes[last[at[lanes]] >= 0]
        got_unit, got_round, got_token, rounds = [], [], [], 0
        here = at[lanes]
        while len(lanes):
            token = last[here]
            to = back[here]
            odd = token == v.unknown
            if odd.any():  # its bytes, last one first
                for lane, a, b in zip(lanes[odd], to[odd], here[odd], strict=True):
                    for k, byte in enumerate(text[a:b][::-1]):
                        got_unit.append([lane])
                        got_round.append([(rounds << 3) + k])
                        got_token.append([v.byte_id[byte]])
            got_unit.append(lanes[~odd])
            got_round.append(np.full(int((~odd).sum()), rounds << 3))
            got_token.append(token[~odd])
            rounds += 1
            more = to > begin[lanes]
            lanes, here = lanes[more], to[more]
        for i, ids in plain.items():
            got_unit.append(np.full(len(ids), i))
            got_round.append(np.arange(len(ids), 0, -1))
            got_token.append(np.array(ids, dtype=np.int32))
        if not got_unit:
            return np.zeros(0, np.int32), np.zeros(len(units), np.int64)
        unit, rnd, token = (np.concatenate(x).astype(np.int64) for x in (got_unit, got_round, got_token))
        order = np.lexsort((-rnd, unit))
        return token[order].astype(np.int32), np.bincount(unit, minlength=len(units))

    def _edges(self, text: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every occurrence; and of every character without a piece."""
        v = self.v
        n = len(text) - 16
        inside = np.zeros(n + 1, dtype=np.int8)
        np.add.at(inside, begin, 1)
        np.add.at(inside, begin + sizes, -1)
        inside = np.cumsum(inside[:n]) > 0
        lead = np.flatnonzero(inside & ((text[:n] & 0xC0) != 0x80))
        key = np.zeros(len(lead), dtype=np.uint64)
        for j in range(8):
            key = (key << np.uint64(8)) | text[lead + j]
        rest = np.zeros(len(lead), dtype=np.uint64)
        for j in range(8, 16):
            rest = (rest << np.uint64(8)) | text[lead + j]
        suffixes = np.lexsort((rest, key))
        key, rest, place = key[suffixes], rest[suffixes], lead[suffixes]
        lo = np.searchsorted(key, self.low, side="left")
        hi = np.searchsorted(key, self.high, side="right")
        checks = []
        for p in self.long[lo[self.long] < hi[self.long]]:
            coded = v.coded[p]
            part = rest[lo[p] : hi[p]]
            a = np.searchsorted(part, np.uint64(int.from_bytes(coded[8:16].ljust(8, b"\x00"), "big")), side="left")
            b = np.searchsorted(part, np.uint64(int.from_bytes(coded[8:16].ljust(8, b"\xff"), "big")), side="right")
            lo[p], hi[p] = lo[p] + a, lo[p] + b
            if len(coded) > 16 and a < b:  # deeper than the order of suffixes: compare the rest
                tail = np.frombuffer(coded[16:], dtype=np.uint8)
                spots = place[lo[p] : hi[p]]
                spots = spots[spots + len(coded) <= n]
                same = np.all(text[spots[:, None] + 16 + np.arange(len(tail))] == tail, axis=1)
                checks.append((np.full(int(same.sum()), p), spots[same]))
                hi[p] = lo[p]
        count = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(count)), count)
        start = place[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        if checks:
            which = np.concatenate((which, *(w for w, _ in checks)))
            start = np.concatenate((start, *(s for _, s in checks)))
        covered = np.zeros(n + 1, dtype=bool)
        covered[start[v.one_char[which]]] = True
        odd = lead[~covered[lead]]
        width = np.where(text[odd] >= 0xF0, 4, np.where(text[odd] >= 0xE0, 3, np.where(text[odd] >= 0xC0, 2, 1)))
        width = np.where(text[odd] == _MARK, 1, width)
        end = start + v.coded_len[which]
        return np.concatenate((start, odd)), np.concatenate((end, odd + width)), np.concatenate((v.coded_id[which], np.full(len(odd), v.unknown, dtype=np.int32)))

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may stand after piece a; a of -1 is no place to come from."""
        key = (a.astype(np.int64) << 32) | b
        slot = (mix64(key.astype(np.uint64)) & np.uint64(len(self.pairs) - 1)).astype(np.int64)
        out = self.touch[slot]
        miss = np.flatnonzero(self.pairs[slot] != key)
        if len(miss):
            fresh, back = np.unique(key[miss], return_inverse=True)
            answer = self._unbroken((fresh >> 32).astype(np.int64), fresh & 0xFFFFFFFF)
            out[miss] = answer[back]
            self.pairs[slot[miss]] = key[miss]
            self.touch[slot[miss]] = out[miss]
        return out

    def _unbroken(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """No merge across the border of a and b comes before those that make a and b.

        Merges are undone, the later of the two sides first (of equal ones the right side, which is made later); a
        pair across the border that would have merged before the merge just undone breaks them."""
        v = self.v
        ok = a >= 0
        live = np.flatnonzero(ok & (a < v.unknown) & (b < v.unknown))
        x, y = a[live], b[live]
        limit = np.full(len(live), np.iinfo(np.int32).max, dtype=np.int64)
        while len(live):
            key = (x << 32) | y
            at = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
            broken = (v.pair_keys[at] == key) & (v.pair_prio[at] < limit)
            ok[live[broken]] = False
            go = ~broken & ((v.prio[x] > 0) | (v.prio[y] > 0))
            live, x, y = live[go], x[go], y[go]
            px, py = v.prio[x].astype(np.int64), v.prio[y].astype(np.int64)
            undo_left = px > py
            limit = np.where(undo_left, px, py + 1)
            x, y = np.where(undo_left, v.right[x], x).astype(np.int64), np.where(undo_left, y, v.left[y]).astype(np.int64)
        return ok


def ragged(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[at[w]:at[w + 1]]`` end to end, and their lengths."""
    sizes = at[which + 1] - at[which]
    index = np.arange(int(sizes.sum())) + np.repeat(at[which] - (np.cumsum(sizes) - sizes), sizes)
    return values[index], sizes


def encode(docs: DataFrame, model_file: str | None = None, text_col: str = "text", check: bool = False) -> DataFrame:
    """``docs`` with ``token_ids``; with ``check`` also ``round_trip``: decoding the ids gives the text again."""
    spark = docs.sparkSession
    docs = docs.drop("token_ids", *["round_trip"] * check)
    shared = spark.sparkContext.broadcast(Vocabulary(model_file or default_model()))
    names, at_text = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for at, part in text_slices(batch.column(at_text), BATCH):
                texts = part.to_pylist()
                tokens, places = encoder.encode(texts)
                columns = [*batch.slice(at, len(texts)).columns, pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(tokens, pa.int32()))]
                if check:
                    data, ends = encoder.decode(tokens, places)
                    buffer = data.tobytes()
                    columns.append(pa.array([buffer[i:j] == (t or "").encode() for i, j, t in zip(ends[:-1], ends[1:], texts, strict=True)]))
                yield pa.RecordBatch.from_arrays(columns, [*names, "token_ids", *["round_trip"] * check])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lean(run), f"{fields}, token_ids array<int>" + ", round_trip boolean" * check)


def decode(encoded: DataFrame, model_file: str | None = None, ids_col: str = "token_ids") -> DataFrame:
    """``encoded`` with ``decoded``: the text of its ids; ids beyond the vocabulary raise an error."""
    spark = encoded.sparkSession
    encoded = encoded.drop("decoded")
    shared = spark.sparkContext.broadcast(Vocabulary(model_file or default_model()))
    names, at_ids = encoded.columns, encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            lists = batch.column(at_ids)
            sizes = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
            data, ends = encoder.decode(np.asarray(lists.flatten(), dtype=np.int32), np.concatenate(([0], np.cumsum(sizes))))
            buffer = data.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([buffer[i:j].decode("utf-8", "replace") for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.string())], [*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(lean(run), f"{fields}, decoded string")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, check=True).select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")

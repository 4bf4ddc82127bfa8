"""Language ID by cross-parsing entropy.

For each language a bounded sample of labelled text goes into a suffix automaton. A text is parsed against each of
them: at every place the longest match is one phrase, a letter without any match is one too. The language that needs
the fewest phrases a letter wins. Many pieces of text are parsed in step, one table lookup a character for all: each
piece first as if a phrase began with it, then again with the phrase that the piece before it left open, until both
parses begin a phrase at the same character, from where they are one. So texts are parsed whole.

Text is first folded: case is dropped, every run of characters that are no letters is one blank, and every letter that
stands anywhere in the samples counts as itself; a letter outside all of them matches nothing.

Defined results: a null text or one without a letter is ``und`` with score 0, and as a labelled row it teaches nothing;
without any usable label every text is ``und``; of more than ``LANGUAGES`` labels those with the most
rows are learned; ties go to the
language first in code-point order; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import lean, materialize, text_slices

UNDETERMINED = "und"
#: Bounds of the fit: labelled rows a language, folded characters a language, and folded characters in all. Languages
#: share the last alike, and the rows of a language share its characters: long ones give up what short ones need.
ROWS, CHARS, ALL_CHARS = 48, 24_000, 120_000
#: Labels that a fit learns, those with the most rows.
LANGUAGES = 100_000
#: Characters of a piece: how many texts are parsed in step follows from it, no result does.
PIECE = 256
#: Bytes of text that are parsed at once, about.
BATCH = 1 << 20
#: Cells up to which an automaton's steps are a table; a larger one is hashed.
TABLE = 3 << 20
#: Above this many phrases a letter, a text of this many characters or more is like none of the languages; shorter ones
#: have too few phrases to tell, and are kept.
ALIEN, ALIEN_CHARS = 0.75, 64


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    letters: tuple[int, ...]  # code points, of class 2 on; 0 is no text, 1 the unknown letter, the last the blank
    edges: tuple[tuple[np.ndarray, np.ndarray], ...]  # of each language: keys state * classes + class, and the states they lead to

    @property
    def classes(self) -> int:
        return len(self.letters) + 3


def fold_classes(letters: tuple[int, ...]) -> np.ndarray:
    """Class by code point up to the last plane: blank for what is no letter."""
    blank = len(letters) + 2
    known = np.ones(0x110000, dtype=np.uint16 if blank < 1 << 16 else np.int32)
    known[list(letters)] = np.arange(2, blank)
    is_letter, lower = _letters()
    return np.where(is_letter, known[lower], known.dtype.type(blank))


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter; its lower case if that is one character, else itself."""
    is_letter = np.zeros(0x110000, dtype=bool)
    lower = np.arange(0x110000, dtype=np.int32)
    for c in range(0x110000):
        if unicodedata.category(x := chr(c))[0] == "L":
            is_letter[c] = True
            if len(y := x.lower()) == 1:
                lower[c] = ord(y)
    return is_letter, lower


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def folded(points: np.ndarray, classes: np.ndarray, rows: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the characters with runs of blanks as one, and the new row starts; rows holds starts and the end."""
    kinds = classes[points]
    keep = np.ones(len(kinds), dtype=bool)
    if len(kinds) > 1:
        keep[1:] = (kinds[1:] != blank) | (kinds[:-1] != blank)
    inner = rows[1:-1]
    keep[inner[inner < len(kinds)]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return kinds[keep], kept[rows]


def suffix_automaton(text: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys state * classes + class and the states they lead to; state 0 is the start. Its paths spell exactly the
    substrings of ``text``."""
    most = 2 * len(text) + 2
    step = [dict() for _ in range(1)]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        new = len(step) - 1
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                twin = len(step) - 1
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    assert len(step) <= most
    keys = np.array([state * classes + c for state, to in enumerate(step) for c in to], dtype=np.int64)
    return keys, np.array([t for to in step for t in to.values()], dtype=np.int32)


class Edges:
    """Steps of one automaton: a table of states by classes while that has at most ``TABLE`` cells, else an open hash
    table, at most a quarter full, so that its size goes with the sample and not with the alphabet."""

    def __init__(self, keys: np.ndarray, to: np.ndarray, classes: int):
        self.classes = classes
        cells = (int(to.max(initial=0)) + 1) * classes
        self.table = None
        if cells <= TABLE:
            self.table = np.full(cells, -1, dtype=np.int32)
            self.table[keys] = to
            return
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.to = np.full(1 << bits, -1, dtype=np.int32)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            left = self.keys[at] != keys  # of several that want a slot one gets it, the others try the next
            self.to[at[~left]] = to[~left]
            keys, to, at = keys[left], to[left], (at[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def step(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The state after each state and class, or -1."""
        keys = state.astype(np.int64) * self.classes + kind
        if self.table is not None:
            return self.table.take(keys)
        at = self._slots(keys)
        to, found = self.to[at], self.keys[at]
        open_ = np.flatnonzero(found != keys)
        if len(open_):
            to[open_] = -1
            open_ = open_[found[open_] >= 0]
            at = at[open_]
            while len(open_):
                at = (at + 1) & self.mask
                found = self.keys[at]
                hit = found == keys[open_]
                to[open_[hit]] = self.to[at[hit]]
                more = ~hit & (found >= 0)
                open_, at = open_[more], at[more]
        return to


def share_of(languages: int, chars: int = CHARS, all_chars: int = ALL_CHARS) -> int:
    """Characters that each language gets, one at least."""
    return max(1, min(chars, all_chars // max(1, languages)))


def labelled_sample(docs: DataFrame, rows: int = ROWS, chars: int = CHARS, all_chars: int = ALL_CHARS, most: int = LANGUAGES) -> DataFrame:
    """``lang, r, text``: the first labelled rows with a letter of each language by a hash of the id, at most ``rows``,
    cut to the characters of a language. Ranks are cut before each shuffle, so a task sends ``rows`` rows a language."""
    usable = F.col("lang").isNotNull() & (F.col("lang") != UNDETERMINED) & F.col("text").rlike(r"\p{L}")
    known = docs.filter(usable).withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    cuts = known.select("lang", "h").withColumn("r", rank).filter(F.col("r") <= rows).groupBy("lang").agg(F.max("h").alias("cut"))
    cuts = materialize(cuts, "language-cuts")
    languages = cuts.limit(most + 1).count()
    if languages > most:
        often = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most)
        cuts, languages = cuts.join(often, "lang", "left_semi"), most
    near = known.join(F.broadcast(cuts), "lang").filter(F.col("h") <= F.col("cut"))
    near = near.select("lang", "h", F.substring("text", 1, share_of(languages, chars, all_chars)).alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    return near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= rows).select("lang", "r", "text")


def fit(docs: DataFrame, rows: int = ROWS, chars: int = CHARS, all_chars: int = ALL_CHARS, most: int = LANGUAGES) -> Model:
    """Automata of a bounded sample of the labelled rows: at most ``rows`` rows and ``chars`` characters a language, and
    ``most`` languages. The driver gets ``rows * max(all_chars, most)`` characters at most."""
    by_lang: dict[str, list[str]] = {}
    for row in labelled_sample(docs, rows, chars, all_chars, most).orderBy("lang", "r").collect():
        by_lang.setdefault(row.lang, []).append(row.text)
    return model_of(by_lang, chars, all_chars)


def fair_cut(sizes: list[int], room: int) -> int:
    """The largest cut to which all sizes can go, so that they fit into ``room`` together."""
    for done, size in enumerate(ordered := sorted(sizes)):
        if size * (len(ordered) - done) >= room:
            return room // (len(ordered) - done)
        room -= size
    return max(sizes, default=0)


def model_of(by_lang: dict[str, list[str]], chars: int = CHARS, all_chars: int = ALL_CHARS) -> Model:
    languages = tuple(sorted(by_lang))
    is_letter, lower = _letters()
    count = np.zeros(0x110000, dtype=bool)
    points = {}
    for lang in languages:
        points[lang] = [code_points([t]) for t in by_lang[lang]]
        for p in points[lang]:
            count[lower[p[is_letter[p]]]] = True
    letters = tuple(np.flatnonzero(count).tolist())
    classes = fold_classes(letters)
    blank, n = len(letters) + 2, len(letters) + 3
    share = share_of(len(languages), chars, all_chars)
    edges = []
    for lang in languages:
        parts = [folded(p, classes, np.array([0, len(p)]), blank)[0] for p in points[lang]]
        cut = fair_cut([len(p) + 1 for p in parts], share)
        text = np.concatenate([np.zeros(0, classes.dtype), *(np.append(p, classes.dtype.type(blank))[:cut] for p in parts)])
        edges.append(suffix_automaton(text, n))
    return Model(languages, letters, tuple(edges))


class Parser:
    """Phrases that each language's automaton needs for each text of a batch."""

    def __init__(self, model: Model):
        self.model = model
        self.classes = fold_classes(model.letters)
        self.edges = [Edges(keys, to, model.classes) for keys, to in model.edges]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts x languages phrases, and the letters of each text."""
        model = self.model
        blank = len(model.letters) + 2
        rows = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        kinds, starts = folded(code_points(texts), self.classes, rows, blank)
        letters = np.concatenate(([0], np.cumsum(kinds != blank)))
        letters = letters[starts[1:]] - letters[starts[:-1]]
        # Pieces as lanes, longest first, so that the live lanes are always a prefix.
        sizes = np.diff(starts)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = starts[owner] + nth * PIECE
        size = np.minimum(PIECE, starts[owner + 1] - at) if len(owner) else np.zeros(0, np.int64)
        order = np.argsort(-size, kind="stable")
        lane_of = np.empty_like(order)
        lane_of[order] = np.arange(len(order))
        before = np.where(nth > 0, lane_of[np.maximum(np.arange(len(order)) - 1, 0)], -1)[order]
        owner, at, size = owner[order], at[order], size[order]
        out = np.zeros((len(texts), len(model.languages)), dtype=np.int64)
        if not len(owner):
            return out, letters
        live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # lanes longer than each step
        columns = np.zeros((int(size[0]), len(owner)), dtype=kinds.dtype)
        for step in range(int(size[0])):
            columns[step, : live[step]] = kinds[at[: live[step]] + step]
        for lang, edges in enumerate(self.edges):
            count = _parsed(edges, columns, live, size, before)
            out[:, lang] = np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)
        return out, letters

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and phrases a letter of each text."""
        if not self.model.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), [1.0] * len(texts)
        phrases, letters = self.phrases(texts)
        best = phrases.argmin(axis=1)
        rate = np.maximum(phrases, 1) / np.maximum(letters, 1)[:, None]
        # Each language's share of the inverse rates, sharpened: a rate some tenths lower is already clear.
        odds = (rate.min(axis=1, keepdims=True) / rate) ** 8
        score = 1.0 / odds.sum(axis=1)
        found = letters > 0
        lang = [self.model.languages[b] if f else UNDETERMINED for b, f in zip(best, found, strict=True)]
        return lang, np.where(found, score, 0.0).tolist(), np.where(found, rate.min(axis=1), 1.0).tolist()


def _parsed(edges: Edges, columns: np.ndarray, live: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Phrases that begin in each lane. ``before`` is the lane of the piece of text before each, or -1."""
    lanes = len(size)
    from_root = np.maximum(edges.step(np.zeros(edges.classes, np.int32), np.arange(edges.classes)), 0)  # 0: a letter that matches nothing

    def step_on(state: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a character, and whether it begins a phrase."""
        to = edges.step(state, kind)
        begins = state == 0
        miss = np.flatnonzero(to < 0)
        to[miss] = from_root[kind[miss]]
        begins[miss] = True
        return to, begins

    begun = np.zeros(columns.shape, dtype=bool)
    alone = np.zeros(lanes, dtype=np.int32)  # the state in which a piece ends if a phrase begins with it
    for step, n in enumerate(live):
        alone[:n], begun[step, :n] = step_on(alone[:n], columns[step, :n])
    count_alone = begun.sum(axis=0)
    state, count = alone.copy(), count_alone.copy()
    after = np.full(lanes, -1, dtype=np.int64)
    follows = np.flatnonzero(before >= 0)
    after[before[follows]] = follows
    todo = follows
    while len(todo):
        carry, old = state[before[todo]], state[todo]
        state[todo], count[todo] = alone[todo], count_alone[todo]
        lane, here = todo[carry != 0], carry[carry != 0]
        extra, seen = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
        step = 0
        while len(lane):
            short = size[lane] <= step
            if short.any():  # the piece ends before the parses meet
                state[lane[short]], count[lane[short]] = here[short], extra[short]
                lane, here, extra, seen = lane[~short], here[~short], extra[~short], seen[~short]
                if not len(lane):
                    break
            here, begins = step_on(here, columns[step, lane])
            also = begun[step, lane]
            met = begins & also
            if met.any():
                count[lane[met]] = extra[met] + count_alone[lane[met]] - seen[met]
                lane, here, extra, seen, begins, also = (x[~met] for x in (lane, here, extra, seen, begins, also))
            extra += begins
            seen += also
            step += 1
        todo = after[todo[state[todo] != old]]  # those that follow a piece with another end
        todo = todo[todo >= 0]
    return count


def _predict(parser: Parser, column: pa.Array) -> tuple[list[str], list[float], list[float]]:
    """Language, score and rate by row, some texts at a time."""
    out: tuple[list, list, list] = ([], [], [])
    for _, part in text_slices(column, BATCH):
        for all_of, some in zip(out, parser.predict([t or "" for t in part.to_pylist()]), strict=True):
            all_of.extend(some)
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, rate``; only the text is read for it. The model's size is bounded by ``ALL_CHARS``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(shared.value)
        for batch in batches:
            lang, score, rate = _predict(parser, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], ["doc_id", "lang_pred", "score", "rate"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double, rate double")


def accepted(docs: DataFrame, model: Model, alien: float = ALIEN, alien_chars: int = ALIEN_CHARS) -> DataFrame:
    """The documents with a language, all columns as they were: neither ``und`` nor, from ``alien_chars`` characters on,
    alien to every language learned: of more than ``alien`` phrases a letter in the nearest one.

    Ids need not tell rows apart, so the text travels with its row through the same parse."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(shared.value)
        for batch in batches:
            lang, _, rate = _predict(parser, batch.column(at))
            long = pc.greater_equal(pc.fill_null(pc.utf8_length(batch.column(at)), 0), alien_chars)
            strange = pc.and_(long, pa.array([r > alien for r in rate]))
            yield batch.filter(pc.and_not(pa.array([x != UNDETERMINED for x in lang]), strange))

    return docs.mapInArrow(lean(run), docs.schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

"""What several operators share: the folder for intermediate tables, packed words and random bits."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes from which a word is hashed on its own.
LONG_WORD = 64
_MUL = 0x9E3779B97F4A7C15
_JOIN = np.uint64(0xE9846AF9B1A615D5)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. One is made only in a local session that names none, as in tests: on a
    cluster the executors would not see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")

        spark.conf.set("spark.checkpoint.dir", at := tempfile.mkdtemp(prefix="corpuskit-"))
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: later steps start from the files, not from its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shielded(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but the text under names that no operator uses, and what gives the names back."""
    inner = {c: c if c == text_col else f"_c{i}" for i, c in enumerate(docs.columns)}
    frame = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()])
    return frame, lambda out: out.select(*[F.col(n).alias(c) for c, n in inner.items()])


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``. Spark reuses its Python workers, so at the end of a task each hands its free memory
    back to the system instead of holding it through the stages that follow."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        give_back()

    return task


def give_back() -> None:
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc: nothing to ask for
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(x + np.uint64((seed * _MUL + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))


def unit(x: np.ndarray) -> np.ndarray:
    """uint64 bits as a double in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def spans(level: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the values ``begin .. begin + size - 1`` for each begin and size, wherever they stand.

    Runs of 1, 2, 4, ... values are hashed at every place; two of them that overlap cover any size."""
    out = np.zeros(len(begin), dtype=np.uint64)
    span = 1
    with np.errstate(over="ignore"):
        while len(begin):
            here = np.flatnonzero((size >= span) & (size < 2 * span))
            if len(here):
                a, b = level[begin[here]], level[begin[here] + size[here] - span]
                out[here] = mix64(mix64(a * _JOIN + b) + size[here].astype(np.uint64))
            if int(size.max()) < 2 * span:
                break
            level = np.concatenate((mix64(level[:-span] * _JOIN + level[span:]), np.zeros(span, np.uint64)))
            span *= 2
    return out


def text_slices(column: pa.Array, max_bytes: int):
    """Cut a string column into runs of rows of at most ``max_bytes`` (one long row stays whole): pairs of first row and slice."""
    column = column.cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1)
        to = min(to, len(column))
        yield at, column.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the offset of each row with the end (null: empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """The words of a run of texts: where each starts and ends in the bytes, and the row's share of them."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_bytes(column)
        n = len(self.data)
        solid = ~((self.data == 32) | ((self.data >= 9) & (self.data <= 13)))
        begins = np.zeros(n + 1, dtype=bool)
        begins[self.offsets] = True  # a row's first byte begins a word even after a solid byte
        first = solid.copy()
        if n:
            first[1:] &= ~solid[:-1] | begins[1:n]
        self.starts = np.flatnonzero(first)
        last = solid.copy()
        if n:
            last[:-1] &= ~solid[1:] | begins[1:n]
        self.ends = np.flatnonzero(last) + 1
        #: Row r has the words rows[r] .. rows[r + 1] - 1.
        self.rows = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each word's bytes, eight bytes a step; long words get a digest each."""
        size = self.ends - self.starts
        one, two = (seeded(size.astype(np.uint64), seed) for seed in (1, 2))
        padded = np.concatenate((self.data, np.zeros(8, np.uint8)))
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        masks = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
        live = np.flatnonzero(size <= LONG_WORD) if len(size) and int(size.max()) > LONG_WORD else np.arange(len(size))
        at, left = self.starts[live], size[live]
        a, b = one[live], two[live]
        while len(live):
            step = eight[at] & masks[np.minimum(left, 8)]
            a, b = mix64(a ^ step), mix64(b ^ step)
            done = left <= 8
            if done.all():
                one[live], two[live] = a, b
                break
            one[live[done]], two[live[done]] = a[done], b[done]
            more = ~done
            live, at, left, a, b = live[more], at[more] + 8, left[more] - 8, a[more], b[more]
        for w in np.flatnonzero(size > LONG_WORD):
            digest = hashlib.blake2b(self.data[self.starts[w] : self.ends[w]].tobytes(), digest_size=16).digest()
            one[w], two[w] = np.frombuffer(digest, dtype=np.uint64)
        return one, two

"""Stateful operators of streams on event time: state in RocksDB variables, timers instead of timeouts.

Rows of a key are taken in the order of their event time within a batch, so that a result does not hang on how a stream
is cut into batches, but for rows that come later than rows of a batch before. Ids and keys may be of any type."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: The state store that state variables need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def _ms(time: pd.Timestamp) -> int:
    return int(time.value // 1_000_000)


class _Timed(StatefulProcessor):
    """One timer a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wake(self, at_ms: int, now: TimerValues) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(at_ms, now.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


class _Repeats(_Timed):
    def __init__(self, id_type: str, keep_ms: int):
        self.id_type, self.keep_ms = id_type, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.first = handle.getValueState("first", f"id {self.id_type}, kept_at timestamp")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable", ignore_index=True)
        old = self.first.get() if self.first.exists() else None
        first = part["id"].iloc[0] if old is None else old[0]
        kept = part["ts"].cummax()
        if old is not None:
            kept = kept.clip(lower=pd.Timestamp(old[1]))
        self.first.update((first.item() if hasattr(first, "item") else first, kept.iloc[-1].to_pydatetime()))
        self.wake(_ms(kept.iloc[-1]) + self.keep_ms, timerValues)
        repeated = part["id"] != first
        plain = lambda values: pd.Series(values, dtype=object)  # noqa: E731  not in Arrow's chunks
        yield pd.DataFrame({"id": plain(part["id"].tolist()), "key": plain([key[0]] * len(part)), "first_id": plain([first] * len(part)), "repeated": repeated, "kept_at": kept})

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        return iter(())


def mark_repeats(captures: DataFrame, keep: str = "30 days") -> DataFrame:
    """``id, key, first_id, repeated, kept_at`` of ``id, key, ts``: each capture beside the first of its key, and when
    the key was last kept by then. A key is forgotten when nothing of it came for ``keep`` of event time, so state stays
    bounded; ``keep`` is the watermark too."""
    kinds = dict(captures.dtypes)
    captures.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    span = int(pd.Timedelta(keep).total_seconds() * 1000)
    out = f"id {kinds['id']}, key {kinds['key']}, first_id {kinds['id']}, repeated boolean, kept_at timestamp"
    return captures.select("id", "key", "ts").withWatermark("ts", keep).groupBy("key").transformWithStateInPandas(_Repeats(kinds["id"], span), out, "Append", "EventTime")


class _Groups(_Timed):
    def __init__(self, item_type: str, gate_ms: int, forget_ms: int):
        self.item_type, self.gate_ms, self.forget_ms = item_type, gate_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.items = handle.getMapState("items", f"item {self.item_type}", "seen boolean")
        self.batch = handle.getValueState("batch", "n int, gone boolean, first long")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["ts", "item_id"], kind="stable")
        n, gone, first = self.batch.get() if self.batch.exists() else (0, False, None)
        out = []
        for item, size, ts in zip(part["item_id"].tolist(), part["size"].tolist(), part["ts"], strict=True):
            if self.items.containsKey((item,)):
                continue
            self.items.updateValue((item,), (True,))
            at = _ms(ts)
            first = at if first is None else first
            if not gone and n and at > first + self.gate_ms:
                out.append((n, "gate"))
                gone = True
            n += 1
            if gone:
                out.append((1, "late"))
            elif size <= 1:
                out.append((1, "single"))
                gone = True
            elif n >= size:
                out.append((n, "complete"))
                gone = True
        self.batch.update((n, gone, first))
        self.wake(first + self.gate_ms + (self.forget_ms if gone else 0), timerValues)
        yield self._rows(key, out)

    @staticmethod
    def _rows(key: tuple[Any, ...], out: list[tuple[int, str]]) -> pd.DataFrame:
        plain = lambda values: pd.Series(values, dtype=object)  # noqa: E731  not in Arrow's chunks
        return pd.DataFrame({"batch_id": plain([key[0]] * len(out)), "items": [n for n, _ in out], "reason": plain([r for _, r in out])})

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, gone, first = self.batch.get()
        if gone:
            self.items.clear()
            self.batch.clear()
            return
        self.batch.update((n, True, first))
        self.wake(first + self.gate_ms + self.forget_ms, timerValues)
        yield self._rows(key, [(n, "gate")])


def group_complete(events: DataFrame, gate_s: int = 90, late: str = "10 minutes") -> DataFrame:
    """``batch_id, items, reason``: when a batch of captures is let go. events: ``batch_id, item_id, size, ts``, one for
    each item that is indexed, ``size`` the items of its batch; repeated events of an item count once.

    A batch goes when all its items are in (``complete``), or ``gate_s`` seconds after its first (``gate``: told by a
    later item of it or by the watermark); a batch of one at once (``single``), and an item that comes after its batch
    went is let go alone (``late``). A batch is forgotten a day after it went."""
    kinds = dict(events.dtypes)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = f"batch_id {kinds['batch_id']}, items int, reason string"
    return events.select("batch_id", "item_id", "size", "ts").withWatermark("ts", late).groupBy("batch_id").transformWithStateInPandas(_Groups(kinds["item_id"], gate_s * 1000, DAY_MS), out, "Append", "EventTime")

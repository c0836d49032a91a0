"""Look-ups as a stream: which requests fetch and which are answered from the kept result."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from scriptorium.operators.lookups import TTL_SECONDS

#: Slots of time per validity period.
SLOTS = 24
#: Requests kept in one state value. A key with no more than these waiting keeps them in one value, under one timer.
BLOCK = 4096
#: The state store that holds lists and timers by key; it also survives a restart.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUTPUT = T.StructType().add("key", "string").add("fetched", "long").add("hits", "long")
_PLACE = T.StructType().add("slot", "long").add("block", "long")
_BLOCK = T.StructType().add("us", T.ArrayType(T.LongType())).add("kept", T.ArrayType(T.BooleanType()))
_COUNT = T.StructType().add("n", "long")
_KEY = T.StructType([*_BLOCK.fields]).add("due", "long").add("slots", "long").add("last", "long")


class _Lookups(StatefulProcessor):
    """Requests wait until the watermark has passed the end of their slot of time.

    A key with few waiting requests has them all in its one state value and one timer, for the end of its first slot; the
    timer folds every slot that has ended. So a key costs a few calls of the state store a batch, however many slots it
    touches. A key with more requests has them in blocks by slot, with a timer for each. Slots are shorter than the
    validity, so a slot holds one kept answer at most and its blocks need no order: the first one after expiry with an
    answer to keep is a minimum over them.
    """

    def __init__(self, ttl: int, width_ms: int) -> None:
        self.ttl, self.width_ms = ttl, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Waiting requests, the time of their timer, the number of slots in blocks, and the last kept answer's time.
        self.own = handle.getValueState("own", _KEY)
        self.blocks = handle.getMapState("blocks", _PLACE, _BLOCK)
        self.counts = handle.getMapState("counts", T.StructType().add("slot", "long"), _COUNT)

    def _slots(self, us: np.ndarray) -> np.ndarray:
        return us // (self.width_ms * 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        us, kept, due, slots, last = self._known()
        for batch in rows:
            us = np.concatenate([us, batch["us"].to_numpy(np.int64)])
            kept = np.concatenate([kept, batch["kept"].to_numpy(bool)])
            if slots or len(us) > BLOCK:
                slots += self._block(us, kept)
                us, kept = us[:0], kept[:0]
        self._keep(us, kept, due, slots, last)
        yield from ()

    def _known(self) -> tuple[np.ndarray, np.ndarray, int | None, int, int | None]:
        us, kept, due, slots, last = self.own.get() or ([], [], None, 0, None)
        return np.asarray(us, np.int64), np.asarray(kept, bool), due, slots, last

    def _keep(self, us: np.ndarray, kept: np.ndarray, due: int | None, slots: int, last: int | None) -> None:
        """Write the key's state, with a timer for the first of the requests that wait in it."""
        end = (int(self._slots(us.min())) + 1) * self.width_ms if len(us) else None
        if end is not None and end != due:
            self.handle.registerTimer(end)
        self.own.update((us.tolist(), kept.tolist(), end, slots, last))

    def _block(self, us: np.ndarray, kept: np.ndarray) -> int:
        """Put requests into blocks by slot; the number of slots that had none."""
        slots = self._slots(us)
        order = np.argsort(slots, kind="stable")
        borders = np.flatnonzero(np.diff(slots[order])) + 1
        return sum(self._wait(int(slots[part[0]]), us[part], kept[part]) for part in np.split(order, borders) if len(part))

    def _wait(self, slot: int, us: np.ndarray, kept: np.ndarray) -> bool:
        known = self.counts.containsKey((slot,))
        n = self.counts.getValue((slot,))[0] if known else 0
        if not known:
            self.handle.registerTimer((slot + 1) * self.width_ms)
        for start in range(0, len(us), BLOCK):
            value = (us[start : start + BLOCK].tolist(), kept[start : start + BLOCK].tolist())
            self.blocks.updateValue((slot, n), value)
            n += 1
        self.counts.updateValue((slot,), (n,))
        return not known

    def _requests(self, slot: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for block in range(n):
            us, kept = self.blocks.getValue((slot, block))
            yield np.asarray(us, np.int64), np.asarray(kept, bool)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        us, kept, due, slots, last = self._known()
        ended = expiredTimerInfo.getExpiryTimeInMs()
        if slots:
            slot = ended // self.width_ms - 1
            # The timer of requests that have moved into blocks finds no slot of its own where it has been worked off.
            if self.counts.containsKey((slot,)):
                fetched, hits, last = self._fold_blocks(slot, last)
                self._keep(us, kept, due, slots - 1, last)
                yield pd.DataFrame({"key": [key[0]], "fetched": [fetched], "hits": [hits]})
            return
        past = self._slots(us) < max(ended, timerValues.getCurrentWatermarkInMs()) // self.width_ms
        if past.any():
            fetched, hits, last = self._fold(us[past], kept[past], last)
            self._keep(us[~past], kept[~past], due, 0, last)
            yield pd.DataFrame({"key": key[0], "fetched": fetched, "hits": hits})

    def _fold(self, us: np.ndarray, kept: np.ndarray, last: int | None) -> tuple[list[int], list[int], int | None]:
        """Fetches and hits by slot, in order of time; at one instant the answer that is kept comes first."""
        order = np.lexsort((~kept, us))
        fetched: dict[int, int] = {}
        hits: dict[int, int] = {}
        for slot, at, keep in zip(self._slots(us[order]).tolist(), us[order].tolist(), kept[order].tolist(), strict=True):
            fetch = last is None or at > last + self.ttl
            fetched[slot] = fetched.get(slot, 0) + fetch
            hits[slot] = hits.get(slot, 0) + (not fetch)
            if fetch and keep:
                last = at
        return list(fetched.values()), list(hits.values()), last

    def _fold_blocks(self, slot: int, last: int | None) -> tuple[int, int, int | None]:
        n = self.counts.getValue((slot,))[0]
        expired = np.iinfo(np.int64).min if last is None else last + self.ttl
        fetch = None
        for us, kept in self._requests(slot, n):
            able = us[kept & (us > expired)]
            if len(able):
                fetch = int(able.min()) if fetch is None else min(fetch, int(able.min()))
        asked = fetched = 0
        for us, kept in self._requests(slot, n):
            asked += len(us)
            before = us > expired if fetch is None else (us > expired) & (us < fetch)
            fetched += int((before & ~kept).sum())
        for block in range(n):
            self.blocks.removeKey((slot, block))
        self.counts.removeKey((slot,))
        if fetch is not None:
            fetched += 1
        return fetched, asked - fetched, last if fetch is None else fetch

    def close(self) -> None:
        pass


def outcomes(requests: DataFrame, ttl_seconds: int = TTL_SECONDS, late: str = "0 seconds", slots: int = SLOTS) -> DataFrame:
    """Numbers of fetches and hits by key and slot of time, each row when the watermark has passed its slot.

    ``requests`` is a stream with ``key``, ``ts`` and, if answers may be empty, ``kept``: whether the request's answer has
    something to keep (null counts as empty). Empty answers are not kept: requests fetch until one brings an answer, and
    hits do not prolong it. At one instant the answer that is kept comes first. Requests may come in any order within
    ``late``; later ones whose time the watermark has passed are dropped by Spark, as those of null keys or times are here.

    No more than ``BLOCK`` requests of a key are gathered: beyond that they wait in blocks in the state store, a minimum and a
    count over the blocks of a slot decide, and one time a key stays. `run` starts it with the state store it needs. Sums by key give the totals.
    """
    width_ms = max(ttl_seconds * 1000 // slots, 1)
    kept = F.coalesce("kept", F.lit(False)) if "kept" in requests.columns else F.lit(True)
    rows = requests.where("key IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    timed = rows.select("key", "ts", F.unix_micros("ts").alias("us"), kept.alias("kept")).withWatermark("ts", late)
    processor = _Lookups(ttl_seconds * 1_000_000, width_ms)
    return timed.groupBy("key").transformWithStateInPandas(processor, OUTPUT, "append", "eventTime")


def run(outcomes: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Work off everything available into a parquet folder; a restarted run goes on from the kept answers."""
    conf, name = outcomes.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    writer = outcomes.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    # A started query keeps the settings it was started with.
    conf.set(name, STORE)
    try:
        return writer.outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def first_of_period(requests: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """The near form without own state: requests of a key drop out while the watermark has not passed its first by ``ttl``.

    Expiry follows the watermark, so that answers stay somewhat longer than asked.
    """
    return requests.withWatermark("ts", f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark(["key"])

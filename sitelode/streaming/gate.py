"""The consent gate on a stream: state per bucket of visitors in lists by time, released by timers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sitelode.operators.events import EVENT_FIELDS
from sitelode.streaming.closing import marked

# Lists that a bucket's waiting rows are dealt to by their slot of time, in turn.
RING = 4
# Buckets that visitors are dealt to. The consents a bucket keeps are read and written as one value, some 20 bytes a visitor.
BUCKETS = 128
OUTPUT = "visitor_id string, ts timestamp, payload string"


def _processor(slot_ms: int, remember_ms: int | None) -> StatefulProcessor:
    """The state processor, of a class made inside a function: it is shipped whole, so executors need not have the package."""
    ring, slot_us = RING, slot_ms * 1000
    columns = ["visitor_id", "us", "kind", "payload"]
    # What a row is, in the order in which rows of one instant count.
    allow, event = 0, 2

    def packed(rows: pd.DataFrame) -> bytes:
        sink = pa.BufferOutputStream()
        table = pa.table(
            [pa.array(rows["visitor_id"], pa.string()), pa.array(rows["us"], pa.int64()), pa.array(rows["kind"], pa.int8()), pa.array(rows["payload"], pa.string())],
            names=columns,
        )
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        return sink.getvalue().to_pybytes()

    def unpacked(block: bytes) -> pd.DataFrame:
        return pa.ipc.open_stream(block).read_all().to_pandas()

    class Gate(StatefulProcessor):
        """Rows wait in the list of their slot of time until the watermark is past the slot.

        A timer at the end of the earliest slot then lets out the events of all slots that are over and whose latest
        consent at their time allows them, keeps the last consent of each visitor, and drops the lists. Lists are appended
        to and dropped, and are written anew only where rows are in them that came ``RING`` slots ahead of others. An
        element of a list is a block of rows, so that calls to the state grow with buckets, not with visitors or rows.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            # The instants of the last consents of those who allow, as a block.
            self.allowed = handle.getValueState("allowed", "block binary")
            # The first and the last slot that rows wait in.
            self.slots = handle.getValueState("slots", "first long, last long")
            self.waiting = [handle.getListState(f"waiting{i}", "block binary") for i in range(ring)]

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            watermark = timerValues.getCurrentWatermarkInMs()
            over = watermark // slot_ms - 1
            # Stragglers that Spark still lets in: their slot is over.
            late, bounds = [], []
            for pdf in rows:
                us = pdf["ts"].to_numpy("datetime64[us]").astype("int64")
                is_event = pdf["payload"].notna().to_numpy()
                # Of a consent: allowed, refused.
                kind = np.where(is_event, event, np.where(pdf["analytics"].eq(True).to_numpy(bool), allow, 1)).astype("int8")
                some = pd.DataFrame({"visitor_id": pdf["visitor_id"].to_numpy(), "us": us, "kind": kind, "payload": pdf["payload"].to_numpy()})
                slot = us // slot_us
                if (slot <= over).any():
                    late.append(some[slot <= over])
                fresh, slot = some[slot > over], slot[slot > over]
                if not len(fresh):
                    continue
                bounds += [int(slot.min()), int(slot.max())]
                for i in np.unique(slot % ring).tolist():
                    self.waiting[i].appendValue((packed(fresh[slot % ring == i]),))
            if bounds:
                held = self.slots.get()
                first, last = min(bounds), max(bounds)
                if held is None or first < held[0]:
                    self.handle.registerTimer((first + 1) * slot_ms)
                if held is not None:
                    first, last = min(first, held[0]), max(last, held[1])
                if held is None or (first, last) != tuple(held):
                    self.slots.update((first, last))
            if late:
                yield from self.judge(pd.concat(late), watermark)

        def judge(self, rows: pd.DataFrame, watermark: int) -> Iterator[pd.DataFrame]:
            """Let events through by the consents at or before them; keep the latest."""
            block = self.allowed.get()
            kept = unpacked(bytes(block[0])) if block is not None else rows[:0]
            # The consents that were kept go before all rows of their visitors, and older ones don't count.
            both = pd.concat([kept.assign(kept=True), rows.assign(kept=False)], ignore_index=True)
            visitor = pd.factorize(both["visitor_id"])[0]
            us, kind, old = both["us"].to_numpy("int64"), both["kind"].to_numpy("int64"), both["kept"].to_numpy(bool)
            since = np.full(visitor.max() + 1, np.iinfo(np.int64).min)
            since[visitor[old]] = us[old]
            order = np.lexsort((kind, us, ~old, visitor))
            order = order[(kind[order] == event) | old[order] | (us[order] >= since[visitor[order]])]
            visitor, us, kind, old = visitor[order], us[order], kind[order], old[order]
            # The place of the latest consent, and whether it is the visitor's.
            place = np.maximum.accumulate(np.where(kind != event, np.arange(len(order)), -1))
            own = (place >= 0) & (visitor[place] == visitor)
            passes = (kind == event) & own & (kind[place] == allow) & (us[place] <= us)
            if remember_ms is not None:
                passes &= us < us[place] + remember_ms * 1000
            # The last consent of each visitor; a refusal is the same as no consent, and needs no state.
            final = np.append(visitor[1:] != visitor[:-1], True) & own
            final = place[final]
            final = final[kind[final] == allow]
            if remember_ms is not None:
                final = final[us[final] // 1000 + remember_ms >= watermark // slot_ms * slot_ms]
            self.keep(pd.DataFrame({"visitor_id": both["visitor_id"].to_numpy()[order[final]], "us": us[final], "kind": allow, "payload": None}))
            if passes.any():
                found = both.iloc[order[passes]]
                yield pd.DataFrame({"visitor_id": found["visitor_id"].to_numpy(), "ts": pd.to_datetime(found["us"].to_numpy(), unit="us"), "payload": found["payload"].to_numpy()})

        def keep(self, kept: pd.DataFrame) -> None:
            if not len(kept):
                self.allowed.clear()
                return
            self.allowed.update((packed(kept),))
            if remember_ms is not None:
                # When the slot in which the first one lapses is over; beside the slots' timers by a millisecond.
                self.handle.registerTimer(((int(kept["us"].min()) // 1000 + remember_ms) // slot_ms + 1) * slot_ms + 1)

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
            at, watermark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
            if at % slot_ms:
                block = self.allowed.get()
                if block is not None:
                    kept = unpacked(bytes(block[0]))
                    rest = kept[kept["us"] // 1000 + remember_ms >= at]
                    if len(rest) < len(kept):
                        self.keep(rest)
                return
            over = watermark // slot_ms - 1
            held = self.slots.get()
            if held is None or held[0] > over:
                return
            first, last = held
            due = []
            for i in {slot % ring for slot in range(first, min(last, over, first + ring - 1) + 1)}:
                blocks = [unpacked(bytes(r[0])) for r in self.waiting[i].get()]
                if not blocks:
                    continue
                rows = pd.concat(blocks)
                later = rows["us"] // slot_us > over
                if not later.all():
                    due.append(rows[~later])
                    self.waiting[i].put([(packed(rows[later]),)]) if later.any() else self.waiting[i].clear()
            if last > over:
                self.slots.update((over + 1, last))
                self.handle.registerTimer((over + 2) * slot_ms)
            else:
                self.slots.clear()
            if due:
                yield from self.judge(pd.concat(due), watermark)

        def close(self) -> None:
            pass

    return Gate()


def gate_stream(
    events: DataFrame,
    consents: DataFrame,
    delay: str = "10 minutes",
    marks: DataFrame | None = None,
    shards: int = 2,
    slot_seconds: int = 600,
    remember_seconds: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Streaming form of ``gate_by_consent``: an event is given once the watermark is past its slot of time.

    State is kept per bucket of visitors, by hash, and shard. A visitor's events are dealt over ``shards`` by hash and the
    far fewer consent records go to all of them, so a very busy visitor is spread over that many tasks and the result stays
    exact. ``buckets`` is fixed for the life of a checkpoint; some hundreds to ten thousands of visitors a bucket are good.
    ``delay`` has to cover the disorder of the input: what comes later is dropped. With ``remember_seconds`` a consent
    lapses that long after it was given, and its visitor is forgotten; otherwise it holds until it is refused. With ``marks`` (see
    ``end_marks``) the end of the input lets out what waits. State has to be in RocksDB.
    """
    payload = F.to_json(F.struct(*EVENT_FIELDS), {"ignoreNullFields": "false"})
    dealt = F.pmod(F.xxhash64("ts", *EVENT_FIELDS), F.lit(shards)).cast("int")
    none = F.lit(None)
    shown = events.select("visitor_id", "ts", none.cast("boolean").alias("analytics"), payload.alias("payload"), dealt.alias("shard"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    given = consents.select("visitor_id", "ts", F.coalesce("analytics", F.lit(False)).alias("analytics"), none.cast("string").alias("payload"), every)
    timeline = marked(shown.unionByName(given), marks, delay, "visitor_id")
    gate = _processor(slot_seconds * 1000, None if remember_seconds is None else remember_seconds * 1000)
    bucket = F.pmod(F.xxhash64("visitor_id"), F.lit(buckets)).cast("int")
    released = timeline.withColumn("bucket", bucket).groupBy("bucket", "shard").transformWithStateInPandas(gate, OUTPUT, "Append", "EventTime")
    fields = ", ".join(f"{name} string" for name in EVENT_FIELDS)
    return released.select("visitor_id", "ts", F.from_json("payload", fields).alias("e")).select("visitor_id", "ts", "e.*")

"""Stock of each item as a stateful stream: balances, open holds, and timers that release holds when their time comes.

Moves (item, id, at, kind, units, hold_id, expires_at) change two balances: what the supplier reported and what is reserved.

* ``count`` adds ``units`` (which may be negative) to what is reported;
* ``hold`` opens a hold of ``units``, until ``expires_at`` if that is given; ``confirm`` keeps it without an end;
* ``release`` frees it, ``settle`` ends it because the reported count already discounts it, ``shortfall`` takes its units off both.

A hold that is not open any more is not ended twice; such moves, and holds opened twice, change nothing and are marked ``applied`` =
false.  When a hold's time comes it is released by a timer, also if no move ever comes again, and a row of kind ``expired`` says so.

Rows are taken in the order of (at, id) within a batch; ``in_order`` is false for a move that is not after the greatest (at, id)
that its item has had.  Null keys are an item of their own; null units are 0.  A checkpoint from before holds lay in buckets is refused."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOVE = "item long, id long, at timestamp, kind string, units long, hold_id long, expires_at timestamp"
ENTRY = "item long, at timestamp, id long, kind string, hold_id long, reported long, reserved long, in_order boolean, applied boolean, seq long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a kind that ends a hold takes off (reported, reserved), in units of it.
ENDS = {"release": (0, 1), "settle": (0, 1), "shortfall": (1, 1)}
_NEVER = -1
#: What one hold that changes makes a batch rewrite is this share of its item's open holds.
BUCKETS = 256
_LEAST = -(1 << 62)


def _micros(times: pd.Series) -> list[int | None]:
    """Microseconds since 1970 of a column of instants; None where there is none."""
    numbers = times.astype("datetime64[us]").astype("int64")
    return numbers.astype(object).where(times.notna(), None).tolist()


def _bucket(hold: int) -> int:
    """Ids with any step between them fall into all buckets."""
    return (hold * 0x9E3779B97F4A7C15 >> 32) % BUCKETS


def _holds(value: tuple) -> dict[int, tuple[int, int]]:
    """hold_id -> (units, until) of a bucket."""
    return {hold: (units, until) for hold, units, until in zip(*value, strict=True)}


def _whole(values: pd.Series) -> list[int | None]:
    return values.astype("Int64").astype(object).where(values.notna(), None).tolist()


class ItemStock(StatefulProcessor):
    """State of an item: (reported, reserved, greatest at, its greatest id, entries so far), and its open holds, in buckets.

    Each call of the state goes to Spark and back, about a millisecond, so holds lie together in ``BUCKETS`` values of a map: a batch
    reads a bucket that it names once, and writes it once at the end.  An item has one timer, at the first end among its holds; a
    timer for each hold that goes through all holds would be quadratic."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.balance = handle.getValueState("balance", "reported long, reserved long, at long, id long, seq long")
        self.open = handle.getMapState("open", "bucket long", "hold_id array<long>, units array<long>, until array<long>")

    def _write(self, bucket: int, held: dict[int, tuple[int, int]]) -> None:
        if held:
            units, until = zip(*held.values(), strict=True)
            self.open.updateValue((bucket,), (list(held), list(units), list(until)))
        elif self.open.containsKey((bucket,)):
            self.open.removeKey((bucket,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.balance.get() if self.balance.exists() else None
        reported, reserved, last, last_id, seq = known or (0, 0, _LEAST, _LEAST, 0)
        batch = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        ats, ids, kinds, holds = _micros(batch["at"]), _whole(batch["id"]), batch["kind"].tolist(), _whole(batch["hold_id"])
        buckets = {hold: _bucket(hold) for hold, kind in zip(holds, kinds, strict=True) if hold is not None and (kind in ENDS or kind in ("hold", "confirm"))}
        stored = {b: _holds(self.open.getValue((b,))) if known is not None and self.open.containsKey((b,)) else {} for b in set(buckets.values())}
        now = {hold: stored[b].get(hold) for hold, b in buckets.items()}
        balances, new, changed = [], [], set()
        for at, number, kind, units, hold, until in zip(ats, ids, kinds, _whole(batch["units"]), holds, _micros(batch["expires_at"]), strict=True):
            held = now.get(hold)
            applied = True
            if kind == "count":
                reported += units or 0
            elif kind == "hold" and hold is not None and held is None:
                now[hold] = (units or 0, _NEVER if until is None else until)
                reserved += units or 0
            elif kind == "confirm" and held is not None:
                now[hold] = (held[0], _NEVER)
            elif kind in ENDS and held is not None:
                reported, reserved = reported - ENDS[kind][0] * held[0], reserved - ENDS[kind][1] * held[0]
                now[hold] = None
            else:
                applied = False
            seq += 1
            balances.append((reported, reserved, (at, number) > (last, last_id), applied, seq))
            last, last_id = max((last, last_id), (at, number))
        for hold, held in now.items():
            own = stored[buckets[hold]]
            if held != own.get(hold):
                changed.add(buckets[hold])
                if held is None:
                    del own[hold]
                else:
                    own[hold] = held
                    new.append(held[1])
        for b in sorted(changed):
            self._write(b, stored[b])
        self._wake(new)
        self.balance.update((reported, reserved, last, last_id, seq))
        columns = dict(zip(["reported", "reserved", "in_order", "applied", "seq"], zip(*balances, strict=True), strict=True))
        yield _frame({"item": [key[0]] * len(ids), "at": batch["at"].tolist(), "id": ids, "kind": kinds, "hold_id": holds, **columns})

    def _wake(self, ends: list[int]) -> None:
        """The item's timer is at the first of ``ends``, unless there is an earlier one."""
        first = min((-(-until // 1000) for until in ends if until != _NEVER), default=None)
        if first is not None and all(first < timer for timer in list(self.handle.listTimers())):
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reported, reserved, last, last_id, seq = self.balance.get() if self.balance.exists() else (0, 0, _LEAST, _LEAST, 0)
        moment = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentProcessingTimeInMs()) * 1000
        # Only what has an end is kept while the buckets go by.
        timed = [(until, hold, units) for _, held in self.open.iterator() for hold, (units, until) in _holds(held).items() if until != _NEVER]
        due = sorted(x for x in timed if x[0] <= moment)
        gone = {hold for _, hold, _ in due}
        for b in sorted(set(map(_bucket, gone))):
            self._write(b, {hold: held for hold, held in _holds(self.open.getValue((b,))).items() if hold not in gone})
        out = []
        for until, hold, units in due:
            reserved -= units
            seq += 1
            out.append((key[0], pd.Timestamp(until, unit="us"), -1, "expired", hold, reported, reserved, None, True, seq))
        if out:
            self.balance.update((reported, reserved, last, last_id, seq))
        # This timer goes when its call ends, so it must not stop the next one.
        first = min((-(-until // 1000) for until, _, _ in timed if until > moment), default=None)
        if first is not None:
            self.handle.registerTimer(first)
        yield _frame(dict(zip(_COLUMNS, zip(*out, strict=True), strict=True)) if out else {c: [] for c in _COLUMNS})

    def close(self) -> None:
        pass


_COLUMNS = ["item", "at", "id", "kind", "hold_id", "reported", "reserved", "in_order", "applied", "seq"]


def _frame(columns: dict[str, list]) -> pd.DataFrame:
    return pd.DataFrame({c: columns[c] for c in _COLUMNS}).astype({"item": "Int64", "id": "Int64", "hold_id": "Int64", "reported": "Int64", "reserved": "Int64", "in_order": "boolean", "applied": "boolean"})


def item_stock(moves: DataFrame) -> DataFrame:
    """The entries (``ENTRY``) of a stream of moves (``MOVE``); sets the session's state store, which holds need.

    Timers make batches without rows, so such a stream never is done: run it with a processing-time trigger, not ``availableNow``."""
    moves.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return moves.groupBy("item").transformWithStateInPandas(ItemStock(), ENTRY, "append", "processingTime")


def run_stock(moves: DataFrame, state: str, seconds: float = 0) -> DataFrame:
    """Works through all moves that are there, then goes on for ``seconds``; returns the entries of this run and all before it.
    ``seq`` numbers the entries of an item."""
    writer = item_stock(moves).writeStream.format("parquet").option("path", f"{state}/entries").option("checkpointLocation", f"{state}/checkpoint")
    query = writer.trigger(processingTime="500 milliseconds").start()
    try:
        # Batches without rows, or none at all, come when all moves are taken in; one that an earlier run left open can come before.
        idle = lambda: [p["numInputRows"] for p in query.recentProgress[-3:]] == [0, 0, 0]
        while query.isActive and not idle() and "Waiting for" not in query.status["message"]:
            query.awaitTermination(0.2)
        query.awaitTermination(seconds or 0.1)
    finally:
        query.stop()
    return moves.sparkSession.read.schema(ENTRY).parquet(f"{state}/entries")

"""Stock feeds as streams: idempotent balances, per-item ledger state, pulls with a cursor, expiring holds, and a view that is kept
up to date from changed keys.

Jobs end by themselves (``availableNow``) and keep their state under one folder, so a new run takes up where the last stopped; a
batch that is run again after a failure writes the same rows once more."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from partmill.streaming.kept import KeptTable, SeenRows


def _run(writer, state: str) -> None:
    writer.option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def ingest_once(updates: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Every update once, by its key: the first by ``order`` in a batch, and none that an earlier batch had.  Returns the table."""
    seen = SeenRows(updates.sparkSession, f"{state}/updates", updates.schema, keys)

    def take(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(batch.columns)
        had = seen.before(number, first).select(F.struct(*keys).alias("_had"))
        seen.add(number, first.join(had, F.struct(*keys).eqNullSafe(F.col("_had")), "left_anti"))

    _run(updates.writeStream.foreachBatch(take), state)
    return seen.read()


_LEDGER = "item long, at timestamp, id long, change long, balance long, in_order boolean"


def _balances(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    balance, last, last_id = state.get if state.exists else (0, 0, -1)
    # One item's rows of one batch; the source's files a batch bound them.
    rows = pd.concat(list(batches)).sort_values(["at", "id"], kind="stable")
    micros = rows["at"].astype("int64") if rows["at"].dtype.kind != "M" else rows["at"].astype("datetime64[us]").astype("int64")
    late = (micros < last) | ((micros == last) & (rows["id"] <= last_id))
    totals = balance + rows["change"].cumsum()
    # The greatest (time, id) of all: a late row of a greater id does not move it.
    last, last_id = max((last, last_id), (int(micros.iloc[-1]), int(rows["id"].iloc[-1])))
    state.update((int(totals.iloc[-1]), last, last_id))
    yield pd.DataFrame({"item": key[0], "at": rows["at"], "id": rows["id"], "change": rows["change"], "balance": totals, "in_order": ~late})


def ledger_state(moves: DataFrame, state: str) -> DataFrame:
    """(item, at, id, change, balance, in_order) of a stream of moves (item, at, id, change): the balance after each, in order of
    time within a batch; ``in_order`` is false for a move that is older than what an earlier batch had."""
    found = moves.groupBy("item").applyInPandasWithState(_balances, _LEDGER, "balance long, at long, id long", "append", GroupStateTimeout.NoTimeout)
    _run(found.writeStream.format("parquet").outputMode("append").option("path", f"{state}/ledger"), state)
    return moves.sparkSession.read.schema(_LEDGER).parquet(f"{state}/ledger")


def kept_view(changes: DataFrame, key: str, recompute: Callable[[DataFrame], DataFrame], schema, state: str) -> DataFrame:
    """A table kept up to date: each batch's distinct keys are computed anew by ``recompute`` (keys -> rows) and take the place of
    theirs; a key that gives no row goes.  Returns the table."""
    view = KeptTable(changes.sparkSession, f"{state}/view", schema, [key])

    def refresh(batch: DataFrame, number: int) -> None:
        keys = batch.select(key).distinct()
        view.replace(number, keys, recompute(keys))

    _run(changes.writeStream.foreachBatch(refresh), state)
    return view.read()


def rebuild(view: DataFrame, everything: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What a view must be, and the keys where it was not (new, stale or changed): the repair that runs now and then."""
    a, b = view.select(key, F.struct(*view.columns).alias("_a")), everything.select(key, F.struct(*view.columns).alias("_b"))
    wrong = a.join(b, key, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)
    return everything, wrong


# ---- pulls ---------------------------------------------------------------------------------------------------------


def apply_pull(stored: DataFrame, pulled: DataFrame, key: str, order: list[str], full: bool = False) -> DataFrame:
    """``stored`` (key, *order, values, withdrawn) after a pull of absolute states (the same without ``withdrawn``).

    Of each key the last state by ``order`` counts, so pulls may overlap, repeat and come late.  A full pull also withdraws what
    it did not see; a withdrawn key comes back when it is seen again."""
    values = [c for c in stored.columns if c not in (key, "withdrawn")]
    both = stored.select(key, *values, "withdrawn", F.lit(False).alias("_seen")).unionByName(pulled.select(key, *values, F.lit(False).alias("withdrawn"), F.lit(True).alias("_seen")))
    last = both.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order, "_seen")).alias("_r"), F.bool_or("_seen").alias("_seen"), F.bool_or(F.col("withdrawn")).alias("_gone"))
    gone = F.when(F.col("_seen"), False).otherwise(F.lit(True) if full else F.col("_gone"))
    return last.select(key, "_r.*", gone.alias("withdrawn")).select(stored.columns)


def next_cursor(pulled: DataFrame, at: str, cursor, overlap: str = "5 minutes"):
    """Where the next pull begins: ``overlap`` before the latest state seen, never before ``cursor``.  Only a pull that was written
    moves it, as the caller keeps the value after writing."""
    seen = pulled.agg(F.max(at) - F.expr(f"INTERVAL {overlap}")).first()[0]
    return cursor if seen is None or (cursor is not None and seen < cursor) else seen


# ---- holds ---------------------------------------------------------------------------------------------------------


def release_due(holds: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """``holds`` (hold_id, item, units, expires_at, status) with open ones due at ``now`` released, and the ledger rows
    (item, hold_id, reserved_change) of that.  Holds without an end stay."""
    due = (F.col("status") == "open") & F.coalesce(F.col("expires_at") <= F.lit(now), F.lit(False))
    entries = holds.where(due).select("item", "hold_id", (-F.col("units")).alias("reserved_change"))
    return holds.withColumn("status", F.when(due, "released").otherwise(F.col("status"))), entries

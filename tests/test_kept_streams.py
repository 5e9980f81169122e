"""Holds with timers, kept tables in buckets, and the paged feed, over several batches and restarts."""

from __future__ import annotations

import datetime
import os
import random

import pandas as pd
import pytest

from partmill.sources import feed
from partmill.streaming import holds, stock
from partmill.streaming.kept import KeptTable

AT = datetime.datetime(2024, 1, 1, 10)


def at(minutes):
    return AT + datetime.timedelta(minutes=minutes)


class Moves:
    """A stream of stock moves in a folder, run until all is read, again and again."""

    def __init__(self, spark, path):
        self.spark, self.folder, self.state = spark, str(path / "in"), f"file:{path}/state"

    def put(self, *rows):
        self.spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], holds.MOVE).coalesce(1).write.mode("append").parquet(self.folder)

    def run(self, seconds=0):
        found = holds.run_stock(self.spark.readStream.schema(holds.MOVE).parquet(self.folder), self.state, seconds).collect()
        return [(r["item"], r["id"], r["kind"], r["hold_id"], r["reported"], r["reserved"], r["in_order"], r["applied"]) for r in sorted(found, key=lambda r: (r["item"], r["id"], r["hold_id"] or 0))]


def test_holds_over_three_batches_and_restarts(spark, tmp_path):
    moves = Moves(spark, tmp_path)
    moves.put((1, 1, at(0), "count", 10), (1, 2, at(1), "hold", 4, 77), (2, 3, at(0), "count", 5), (1, 4, at(2), "hold", 1, 77))
    assert moves.run() == [(1, 1, "count", None, 10, 0, True, True), (1, 2, "hold", 77, 10, 4, True, True), (1, 4, "hold", 77, 10, 4, True, False), (2, 3, "count", None, 5, 0, True, True)]
    # Late by time, late by id at an equal time; the greatest (at, id) stays (2 min, 4).
    moves.put((1, 99, at(1), "count", 2), (1, 3, at(2), "count", 1))
    assert [r[1:] for r in moves.run() if r[1] in (3, 99) and r[0] == 1] == [(3, "count", None, 13, 4, False, True), (99, "count", None, 12, 4, False, True)]
    moves.put((1, 5, at(2), "count", 1), (1, 6, at(3), "shortfall", None, 77), (1, 7, at(4), "release", None, 77), (2, 8, at(1), "settle", None, 9), (2, 9, at(2), "odd"))
    assert [r[1:] for r in moves.run() if r[1] in (5, 6, 7, 8, 9)] == [(5, "count", None, 14, 4, True, True), (6, "shortfall", 77, 10, 0, True, True), (7, "release", 77, 10, 0, True, False), (8, "settle", 9, 5, 0, True, False), (9, "odd", None, 5, 0, True, False)]


def test_holds_expire_without_new_input(spark, tmp_path):
    moves = Moves(spark, tmp_path)
    soon, never = datetime.datetime.now() + datetime.timedelta(seconds=4), datetime.datetime.now() + datetime.timedelta(days=900)
    moves.put((1, 1, at(0), "hold", 4, 70, soon), (1, 2, at(0), "hold", 2, 71, soon), (1, 3, at(1), "confirm", None, 71), (1, 4, at(2), "hold", 1, 72, never), (2, 5, at(0), "hold", 9, 73, AT))
    found = moves.run(seconds=25)
    assert [(r[0], r[3], r[5]) for r in found if r[2] == "expired"] == [(1, 70, 3), (2, 73, 0)]
    moves.put((1, 6, at(3), "release", None, 70), (1, 7, at(4), "release", None, 71))
    assert [r[1:] for r in moves.run() if r[1] in (6, 7)] == [(6, "release", 70, 0, 3, True, False), (7, "release", 71, 0, 1, True, True)]


class Calls:
    """A processor's handle and states, in memory; counts what is asked of them."""

    def __init__(self):
        self.values, self.timers, self.count = {}, set(), 0

    def getValueState(self, *schema):
        return self

    getMapState = getValueState

    def _called(self, result=None):
        self.count += 1
        return result

    def exists(self):
        return self._called("" in self.values)

    def get(self):
        return self._called(self.values[""])

    def update(self, value):
        self._called(self.values.update({"": value}))

    def containsKey(self, key):
        return self._called(key in self.values)

    def getValue(self, key):
        return self._called(self.values.get(key))

    def updateValue(self, key, value):
        self._called(self.values.update({key: value}))

    def removeKey(self, key):
        self._called(self.values.pop(key))

    def iterator(self):
        return iter([(k, v) for k, v in self.values.items() if k])

    def listTimers(self):
        return iter(self._called(self.timers))

    def registerTimer(self, at):
        self._called(self.timers.add(at))

    getExpiryTimeInMs = getCurrentProcessingTimeInMs = lambda self: 2_000_000


def test_holds_ask_little_of_the_state():
    """4,000 holds with ends of their own: one timer, and a call for each bucket, not for each hold."""
    calls, item = Calls(), holds.ItemStock()
    item.init(calls)
    n = 4000
    rows = {"item": 1, "id": range(n), "at": AT, "kind": "hold", "units": 1, "hold_id": [388 * k for k in range(n)], "expires_at": pd.to_datetime([1_000_000 + k if k % 2 else 3_000_000 for k in range(n)], unit="ms")}
    assert list(next(item.handleInputRows((1,), iter([pd.DataFrame(rows)]), calls))["reserved"]) == list(range(1, n + 1))
    assert calls.timers == {1_000_001}
    expired = next(item.handleExpiredTimer((1,), calls, calls))
    assert list(expired["hold_id"]) == [388 * k for k in range(1, n, 2)] and list(expired["reserved"]) == list(range(n - 1, n // 2 - 1, -1))
    assert calls.timers == {1_000_001, 3_000_000} and calls.count < 1500
    ended = next(item.handleInputRows((1,), iter([pd.DataFrame(rows | {"id": range(n, 2 * n), "kind": "release"})]), calls))
    assert list(ended["applied"]) == [k % 2 == 0 for k in range(n)] and list(ended["seq"])[-1] == 2 * n + n // 2
    assert set(calls.values) == {""}


def test_a_ledger_keeps_the_greatest_pair(spark, tmp_path):
    folder, state, schema = str(tmp_path / "in"), f"file:{tmp_path}/state", "item long, at timestamp, id long, change long"
    for rows in ([(1, at(100), 50, 1)], [(1, at(90), 99, 1)], [(1, at(100), 60, 1), (1, at(100), 50, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        got = stock.ledger_state(spark.readStream.schema(schema).parquet(folder), state)
    assert sorted((r["id"], r["balance"], r["in_order"]) for r in got.collect()) == [(50, 1, True), (50, 3, False), (60, 4, True), (99, 2, False)]


def files_below(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_kept_table_rewrites_only_the_buckets_it_must(spark, tmp_path):
    table = KeptTable(spark, f"file:{tmp_path}/t", "id long, name string", ["id"], buckets=16)
    put = lambda number, gone, rows: table.replace(number, spark.createDataFrame([(g,) for g in gone], "id long"), spark.createDataFrame(rows, "id long, name string"))
    want = {k: f"n{k}" for k in range(200)} | {None: "none"}
    put(0, want, list(want.items()))
    assert {r["id"]: r["name"] for r in table.read().collect()} == want
    before = files_below(tmp_path / "t" / "rows")
    put(1, [5, 6, None], [(5, "five")])
    del want[6], want[None]
    want[5] = "five"
    assert {r["id"]: r["name"] for r in table.read().collect()} == want
    after = files_below(tmp_path / "t" / "rows")
    assert 1 <= len({os.path.dirname(f) for f in after.keys() - before.keys()}) <= 3 and len(after) <= len(before) + 3
    # A batch that failed after its rows were laid aside is done again from there.
    put(1, [5, 6, None], [(5, "not written again")])
    assert {r["id"]: r["name"] for r in table.read().collect()} == want
    put(2, list(want), [])
    assert table.read().collect() == [] and os.listdir(tmp_path / "t" / "aside") == ["2"]


def test_seen_rows_are_only_added(spark, tmp_path):
    folder, state, schema = str(tmp_path / "in"), f"file:{tmp_path}/state", "supplier long, update_id long, at long"
    rng, want = random.Random(2), {}
    for number in range(3):
        rows = [(rng.choice([1, 2, None]), rng.randrange(30), number * 100 + k) for k in range(40)]
        for s, u, t in rows:
            want.setdefault((s, u), t)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        got = stock.ingest_once(spark.readStream.schema(schema).parquet(folder), ["supplier", "update_id"], ["at"], state)
        assert {(r["supplier"], r["update_id"]): r["at"] for r in got.collect()} == want
    assert got.count() == len(want)


# ---- feed ----------------------------------------------------------------------------------------------------------


def write_feed(spark, folder, rows, version="v1", now=0):
    feed.write_feed(spark.createDataFrame(rows, "id long, changed_at timestamp, quantity long"), folder, version, at(now))


def test_feed_in_pages_by_key(spark, tmp_path):
    folder = f"file:{tmp_path}/feed"
    write_feed(spark, folder, [(k, at(k % 50), k * 10) for k in range(1, 1001)])
    found = spark.read.format("stock_feed").schema("id long, changed_at timestamp, quantity long").option("path", folder).option("page_size", 37).option("partitions", 5).load()
    assert found.rdd.getNumPartitions() == 5
    assert sorted((r["id"], r["quantity"]) for r in found.collect()) == [(k, k * 10) for k in range(1, 1001)]
    part = spark.read.format("stock_feed").schema("id long, changed_at timestamp, quantity long").option("path", folder).option("since", at(48).isoformat()).load()
    assert {r["id"] % 50 for r in part.collect()} == {48, 49}
    write_feed(spark, folder, [])
    assert found.collect() == []


def test_feed_refuses_pages_that_repeat(spark, tmp_path):
    pages = feed.Pages(lambda after, since, limit: {"items": [(1, None, 1)], "next": 0, "version": "v", "server_time": "t"}, "v", 10)
    with pytest.raises(feed.FeedFailed):
        list(pages.rows(0, 100, None))
    moved = feed.Pages(lambda after, since, limit: {"items": [], "next": None, "version": "w", "server_time": "t"}, "v", 10)
    with pytest.raises(feed.VersionMoved):
        list(moved.rows(0, 100, None))


def test_feed_as_a_stream_gives_the_last_states(spark, tmp_path):
    folder, state = f"file:{tmp_path}/feed", f"file:{tmp_path}/state"
    schema = "id long, changed_at timestamp, quantity long"
    rows = {k: (k, at(k), k) for k in range(1, 101)}
    run = lambda: {r["id"]: (r["quantity"], r["withdrawn"]) for r in feed.pull_stream(spark, folder, schema, state).collect()}
    write_feed(spark, folder, list(rows.values()), now=200)
    assert run() == {k: (k, False) for k in rows}
    rows |= {7: (7, at(201), 700), 300: (300, at(202), 3)}
    write_feed(spark, folder, list(rows.values()), now=210)
    assert run() == {k: (r[2], False) for k, r in rows.items()}
    # What does not change is not asked for again; without a change of version, a missing item stays.
    kept = dict(rows)
    del rows[8]
    write_feed(spark, folder, list(rows.values()), now=220)
    assert run() == {k: (r[2], False) for k, r in kept.items()}
    # The version moved: all is pulled, and what is not there any more is withdrawn.
    write_feed(spark, folder, list(rows.values()), version="v2", now=230)
    assert run() == {k: (r[2], k == 8) for k, r in kept.items()}
    assert run() == {k: (r[2], k == 8) for k, r in kept.items()}


def test_plan_of_the_next_pull():
    day = datetime.timedelta(days=1)
    assert feed.plan(None, None, None, AT) == ("full", None)
    assert feed.plan(at(0), at(1), at(-3000), at(10)) == ("day", at(0) - day)  # 03:00 has passed since the last repair
    assert feed.plan(at(0), at(1), AT, at(10)) == ("changes", at(0))
    assert feed.plan(at(0), at(1), AT, AT + 7 * day) == ("full", None)


def test_a_page_reads_only_the_row_groups_it_reaches(tmp_path, monkeypatch):
    import json

    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "data").mkdir()
    for k in range(2):  # keys 1 to 100, ten to a row group
        ids = list(range(50 * k + 1, 50 * k + 51))
        pq.write_table(pa.table({"id": ids, "changed_at": pa.array([AT] * 50, pa.timestamp("us", "UTC"))}), tmp_path / "data" / f"{k}.parquet", row_group_size=10)
    (tmp_path / "feed.json").write_text(json.dumps({"data": "data", "version": "1", "server_time": AT.isoformat(), "last": 100}))
    read, whole = [], feed.FolderFeed._read
    monkeypatch.setattr(feed.FolderFeed, "_read", staticmethod(lambda fragment, since: read.append(1) or whole(fragment, since)))
    client, after, seen = feed.FolderFeed(f"file:{tmp_path}"), 0, []
    while after is not None:
        page = client.fetch(after, None, 7)
        seen += [item[0] for item in page["items"]]
        after = page["next"]
    assert seen == list(range(1, 101)) and len(read) == 10
    assert [i[0] for i in feed.FolderFeed(f"file:{tmp_path}").fetch(94, None, 7)["items"]] == [95, 96, 97, 98, 99, 100] and len(read) == 11

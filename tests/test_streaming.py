from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from partmill.streaming import events, stock

AT = datetime.datetime(2024, 1, 1, 10)


def rows(*minutes, user=1, first=0):
    return [(first + k, AT + datetime.timedelta(minutes=m), user, "view", 1.0, "{}") for k, m in enumerate(minutes)]


def test_repeats_are_dropped_and_visits_end_after_half_an_hour(spark, tmp_path):
    batch = spark.createDataFrame(rows(0, 10, 39, 80) + rows(0, 10, 39, 80)[:2] + rows(5, 600, user=2, first=10), events.SCHEMA)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    unique = events.run_once(events.first_of_each(events.read_events(spark, str(tmp_path / "in"))))
    assert sorted(r["event_id"] for r in unique.collect()) == [0, 1, 2, 3, 10, 11]
    unique.select("event_id", "ts", "user_id", "event_type", "value", "props").withColumn("ts", unique["ts"].cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "unique"))
    got = events.run_once(events.visits(events.read_events(spark, str(tmp_path / "unique"))))
    assert sorted((r["user_id"], r["events"]) for r in got.collect()) == [(1, 1), (1, 3), (2, 1)]


def test_conflicting_repeats(spark):
    batch = spark.createDataFrame([*rows(0, 1), *rows(0), (1, AT, 9, "click", 2.0, "{}")], events.SCHEMA)
    assert [r["event_id"] for r in events.conflicting_repeats(batch).collect()] == [1]


def test_updates_are_taken_in_once_over_several_runs(spark, tmp_path):
    folder, state = str(tmp_path / "in"), f"file:{tmp_path}/state"
    schema = "supplier long, update_id long, at long, balance long"
    read = lambda: spark.readStream.schema(schema).parquet(folder)
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    put([(1, 1, 10, 5), (1, 1, 11, 6), (1, 2, 12, 7)])
    stock.ingest_once(read(), ["supplier", "update_id"], ["at"], state)
    put([(1, 2, 13, 9), (2, 1, 14, 1)])
    got = stock.ingest_once(read(), ["supplier", "update_id"], ["at"], state)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 10, 5), (1, 2, 12, 7), (2, 1, 14, 1)]


def test_ledger_state_goes_on_and_tells_late_moves(spark, tmp_path):
    folder, state = str(tmp_path / "in"), f"file:{tmp_path}/state"
    schema = "item long, at timestamp, id long, change long"
    at = lambda m: AT + datetime.timedelta(minutes=m)
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    put([(1, at(5), 2, 10), (1, at(1), 1, 3), (2, at(0), 3, 1)])
    stock.ledger_state(spark.readStream.schema(schema).parquet(folder), state)
    put([(1, at(4), 4, -1), (1, at(9), 5, 2)])
    got = stock.ledger_state(spark.readStream.schema(schema).parquet(folder), state)
    assert sorted((r["item"], r["id"], r["balance"], r["in_order"]) for r in got.collect()) == [(1, 1, 3, True), (1, 2, 13, True), (1, 4, 12, False), (1, 5, 14, True), (2, 3, 1, True)]


def test_a_view_follows_changed_keys_and_is_repaired(spark, tmp_path):
    folder, state = str(tmp_path / "in"), f"file:{tmp_path}/state"
    base = {"rows": [(1, "a"), (2, "b"), (3, "c")]}
    table = lambda: spark.createDataFrame(base["rows"], "id long, name string")
    put = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(folder)
    run = lambda: stock.kept_view(spark.readStream.schema("id long").parquet(folder), "id", lambda keys: table().join(keys, "id", "left_semi"), "id long, name string", state)
    put(1, 2, 2, 3)
    assert sorted(tuple(r) for r in run().collect()) == [(1, "a"), (2, "b"), (3, "c")]
    base["rows"] = [(1, "A"), (3, "C")]
    put(1, 2)
    view = run()
    assert sorted(tuple(r) for r in view.collect()) == [(1, "A"), (3, "c")]
    assert [r["id"] for r in stock.rebuild(view, table(), "id")[1].collect()] == [3]


def test_pulls_may_overlap_and_a_full_one_withdraws(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "id long, at timestamp_ntz, n long")
    at = lambda m: AT + datetime.timedelta(minutes=m)
    stored = stock.apply_pull(rows().withColumn("withdrawn", F.lit(False)), rows((1, at(1), 5), (2, at(2), 6)), "id", ["at"], full=True)
    assert stock.next_cursor(rows((1, at(60), 5)), "at", None) == at(55) and stock.next_cursor(rows(), "at", at(3)) == at(3)
    stored = stock.apply_pull(stored, rows((1, at(0), 9), (2, at(3), 7)), "id", ["at"])
    assert sorted(tuple(r) for r in stored.collect()) == [(1, at(1), 5, False), (2, at(3), 7, False)]
    stored = stock.apply_pull(stored, rows((1, at(1), 5)), "id", ["at"], full=True)
    assert sorted((r["id"], r["withdrawn"]) for r in stored.collect()) == [(1, False), (2, True)]
    stored = stock.apply_pull(stored, rows((3, at(9), 1)), "id", ["at"])
    assert sorted((r["id"], r["withdrawn"]) for r in stored.collect()) == [(1, False), (2, True), (3, False)]


def test_holds_that_are_due_are_released(spark):
    holds = spark.createDataFrame([(1, 7, 5, AT, "open"), (2, 7, 2, None, "open"), (3, 8, 4, AT, "closed"), (4, 8, 1, AT + datetime.timedelta(1), "open")], "hold_id long, item long, units long, expires_at timestamp_ntz, status string")
    after, entries = stock.release_due(holds, AT)
    assert sorted((r["hold_id"], r["status"]) for r in after.collect()) == [(1, "released"), (2, "open"), (3, "closed"), (4, "open")]
    assert [tuple(r) for r in entries.collect()] == [(7, 1, -5)]

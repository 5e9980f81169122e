"""Streams over the events table, run until all is read; each query returns the table that its stream wrote."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from partmill.sources import feed
from partmill.sources.storage import materialize, shared_path
from partmill.sources.storage import read_table as t
from partmill.streaming import events, holds, stock

_PULL_AT, _NOW = "2024-01-15 00:00:00", datetime.datetime(2024, 1, 20)


def _stream(spark, sf):
    return events.read_events(spark, f"{sf}/events.parque[t]")  # a pattern: a stream does not take a single file


def stream_first_events(spark, sf):
    """Every event id once."""
    return events.run_once(events.first_of_each(_stream(spark, sf))).select("event_id", "user_id", "event_type", "value")


def stream_rejects(spark, sf):
    """Events taken in by an id that two share: the first of each, and the other as rejected."""
    halved = _stream(spark, sf).withColumn("number", F.col("event_id")).withColumn("event_id", F.expr("event_id div 2"))
    taken, rejected = events.take_events(halved, shared_path(spark, "stream-rejects"), own="number")
    count = lambda df, what: df.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids")).withColumn("outcome", F.lit(what))
    return count(taken, "taken").unionByName(count(rejected, "rejected"))


def stream_visits(spark, sf):
    """Sessions of 30 minutes that the watermark has closed."""
    return events.run_once(events.visits(_stream(spark, sf))).select("user_id", F.unix_micros("started_at").alias("started_micros"), "events")


def stream_ingest_once(spark, sf):
    """Updates by (type, number): each once, the earliest."""
    updates = _stream(spark, sf).select("event_type", F.floor(F.col("event_id") / 2).cast("long").alias("update_id"), "event_id", "value")
    return stock.ingest_once(updates, ["event_type", "update_id"], ["event_id"], shared_path(spark, "stream-ingest"))


def stream_ledger_state(spark, sf):
    moves = _stream(spark, sf).select(F.col("user_id").alias("item"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.round(F.col("value") * 100).cast("long").alias("change"))
    return stock.ledger_state(moves, shared_path(spark, "stream-ledger")).select("item", "id", "change", "balance", "in_order")


def stream_kept_view(spark, sf):
    """Counts of every user that had an event, computed anew for the users that changed."""
    whole = t(spark, sf, "events")
    counts = lambda keys: whole.join(keys, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("events"), F.max("event_id").alias("last_event"))
    return stock.kept_view(_stream(spark, sf).select("user_id"), "user_id", counts, "user_id long, events long, last_event long", shared_path(spark, "stream-view"))


def pull_with_cursor(spark, sf):
    """The state after a first full pull, an overlapping later one, and a full one that no longer has some users."""
    e = t(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    empty = e.limit(0).withColumn("withdrawn", F.lit(False))
    at = F.lit(_PULL_AT).cast("timestamp_ntz")
    order = ["ts", "event_id"]
    first = e.where(F.col("ts") < at)
    stored = materialize(stock.apply_pull(empty, first, "user_id", order, full=True), "pull")
    since = stock.next_cursor(first, "ts", None)
    stored = materialize(stock.apply_pull(stored, e.where(F.col("ts") >= F.lit(since)), "user_id", order), "pull")
    return materialize(stock.apply_pull(stored, e.where("user_id % 7 <> 0"), "user_id", order, full=True), "pull")


def hold_expiry(spark, sf):
    """Holds that end within a day of their event, those due released."""
    holds = t(spark, sf, "events").select(
        F.col("event_id").alias("hold_id"), F.col("user_id").alias("item"), F.ceil("value").cast("long").alias("units"),
        F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"), F.when(F.col("event_type") == "error", "closed").otherwise("open").alias("status"),
    )
    released, entries = stock.release_due(holds, _NOW)
    return released.join(entries.select("hold_id", "reserved_change"), "hold_id", "left").select("hold_id", "status", "reserved_change")


def stream_stock_holds(spark, sf):
    """Balances of items after counts, holds with and without an end, releases and settlements; holds that are due expire by timers."""
    step, own = F.col("event_id") % 4, F.col("event_id") - F.col("event_id") % 4
    moves = _stream(spark, sf).select(
        (F.floor(F.col("event_id") / 4) % 97).cast("long").alias("item"), F.col("event_id").alias("id"), F.timestamp_seconds("event_id").alias("at"),
        F.when(step == 0, "count").when(step == 1, "hold").when((step == 2) & (own % 3 == 0), "release").when((step == 3) & (own % 5 == 0), "settle").otherwise("none").alias("kind"),
        F.ceil("value").cast("long").alias("units"), F.when(step > 0, own).alias("hold_id"), F.when((step == 1) & (own % 7 == 0), F.timestamp_seconds(F.col("event_id") + 100)).alias("expires_at"),
    )
    entries = holds.run_stock(moves, shared_path(spark, "stream-holds"))
    last = F.max_by(F.struct("reported", "reserved"), "seq").alias("b")
    return entries.groupBy("item").agg(last, F.count_if(~F.col("applied")).alias("void")).select("item", "b.reported", "b.reserved", "void")


def feed_pull(spark, sf):
    """A paged feed in three states, pulled in turn: what was there at first, what changed, and, in another version, less than before."""
    e = t(spark, sf, "events").select((F.col("event_id") + 1).alias("id"), F.col("ts").cast("timestamp").alias("changed_at"), F.round(F.col("value") * 100).cast("long").alias("quantity"))
    cut = datetime.datetime.fromisoformat(_PULL_AT)
    folder, state, schema = shared_path(spark, "feed-source"), shared_path(spark, "feed-state"), "id long, changed_at timestamp, quantity long"
    later = datetime.timedelta(days=1000)
    for rows, version, at in ((e.where(F.col("changed_at") < F.lit(_PULL_AT).cast("timestamp")), "1", cut), (e, "1", cut + later), (e.where("id % 9 <> 0"), "2", cut + 2 * later)):
        feed.write_feed(rows, folder, version, at)
        kept = feed.pull_stream(spark, folder, schema, state, page_size=10_000)
    return kept.select("id", "quantity", "withdrawn")


QUERIES = {
    "stream_first_events": (stream_first_events, "SELECT event_id, MIN(user_id) AS user_id, MIN(event_type) AS event_type, MIN(value) AS value FROM events GROUP BY 1"),
    "stream_rejects": (stream_rejects, """WITH e AS (SELECT event_id // 2 AS id, event_type, row_number() OVER (PARTITION BY event_id // 2 ORDER BY ts, event_id) = 1 AS first FROM events)
        SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT id) AS ids, CASE WHEN first THEN 'taken' ELSE 'rejected' END AS outcome FROM e GROUP BY event_type, first"""),
    "stream_visits": (stream_visits, """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS visit FROM g)
        SELECT user_id, epoch_us(MIN(ts)) AS started_micros, COUNT(*) AS events FROM s GROUP BY user_id, visit HAVING MAX(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('milliseconds', MAX(ts)) - INTERVAL 1 HOUR FROM events)"""),
    "stream_ingest_once": (stream_ingest_once, "SELECT event_type, event_id // 2 AS update_id, MIN(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2"),
    "stream_ledger_state": (stream_ledger_state, """SELECT user_id AS item, event_id AS id, CAST(round(value * 100) AS BIGINT) AS change,
        CAST(SUM(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS balance, TRUE AS in_order FROM events"""),
    "stream_kept_view": (stream_kept_view, "SELECT user_id, COUNT(*) AS events, MAX(event_id) AS last_event FROM events GROUP BY 1"),
    "stream_stock_holds": (stream_stock_holds, """WITH m AS (SELECT event_id // 4 % 97 AS item, event_id - event_id % 4 AS own, event_id % 4 AS step, CAST(ceil(value) AS BIGINT) AS units FROM events),
        k AS (SELECT item, step, own, units, CASE WHEN step = 2 AND own % 3 = 0 THEN 'end' WHEN step = 3 AND own % 5 = 0 THEN 'end' WHEN step > 1 THEN 'none' END AS kind FROM m),
        h AS (SELECT own, item, MAX(units) FILTER (step = 1) AS held, COUNT(*) FILTER (kind = 'end') AS ends FROM k GROUP BY 1, 2),
        b AS (SELECT item, CAST(SUM(CASE WHEN ends = 0 AND own % 7 <> 0 THEN held ELSE 0 END) AS BIGINT) AS reserved, SUM(greatest(ends - 1, 0)) + SUM(CASE WHEN held IS NULL THEN least(ends, 1) ELSE 0 END) AS void FROM h GROUP BY 1)
        SELECT item, CAST(COALESCE(SUM(units) FILTER (step = 0), 0) AS BIGINT) AS reported, any_value(reserved) AS reserved, CAST(any_value(void) + COUNT(*) FILTER (kind = 'none') AS BIGINT) AS void FROM k JOIN b USING (item) GROUP BY 1"""),
    "feed_pull": (feed_pull, "SELECT event_id + 1 AS id, CAST(round(value * 100) AS BIGINT) AS quantity, (event_id + 1) % 9 = 0 AS withdrawn FROM events"),
    "pull_with_cursor": (pull_with_cursor, "SELECT user_id, MAX(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, user_id % 7 = 0 AS withdrawn FROM events GROUP BY 1"),
    "hold_expiry": (hold_expiry, f"""WITH h AS (SELECT event_id AS hold_id, CAST(ceil(value) AS BIGINT) AS units, event_type <> 'error' AND event_id % 5 <> 0 AND ts + INTERVAL 1 DAY <= TIMESTAMP '{_NOW}' AS due, event_type FROM events)
        SELECT hold_id, CASE WHEN event_type = 'error' THEN 'closed' WHEN due THEN 'released' ELSE 'open' END AS status, CASE WHEN due THEN -units END AS reserved_change FROM h"""),
}

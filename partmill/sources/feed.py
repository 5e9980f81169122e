"""A paged stock feed as a Spark data source, batch and stream.

A feed answers ``fetch(after, since, limit)`` with a page: the items of a key above ``after`` that changed at ``since`` or later, by
key, ``limit`` at most; ``next``, the key to go on after (None at the end); the feed's ``version`` and its ``server_time``; and
``last``, the greatest key.  Items are absolute states.

Keys are split into ranges, a partition each, which tasks page through on their own.  Every page must be of the version that the
read was planned with: if the supplier publishes otherwise meanwhile the read fails (``VersionMoved``) and is begun anew, in full.
As a stream the offset is the feed's time and version at planning; Spark keeps it when the batch is written, so a failed pull is
pulled again from where the last one began."""

from __future__ import annotations

import datetime
import importlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from partmill.sources import blobs
from partmill.sources.storage import materialize

PAGE_SIZE, PARTITIONS = 500, 8
#: How long a feed accepts ``since``; of how far back the daily repair asks, and when it is due.
FULL_AFTER, REPAIR_BACK, REPAIR_AT = datetime.timedelta(days=6), datetime.timedelta(hours=24), datetime.time(3)


class FeedFailed(Exception):
    """The feed's answer is not one."""


class VersionMoved(FeedFailed):
    """The supplier changed what is published; what was read so far is of no use."""


# ---- clients -------------------------------------------------------------------------------------------------------


class FolderFeed:
    """A feed that is a folder: ``feed.json`` names the present state, a Parquet table with ``id`` and ``changed_at``."""

    def __init__(self, path: str):
        self.path, self.data, self.groups, self.kept = path, None, [], {}

    def _state(self) -> dict:
        with blobs.open_random(f"{self.path}/feed.json") as f:
            return json.loads(f.read().decode())

    def fetch(self, after: int, since: str | None, limit: int) -> dict:
        state = self._state()
        store, path = blobs.open_store(f"{self.path}/{state['data']}")
        page = {"items": [], "next": None, "version": state["version"], "server_time": state["server_time"], "last": state["last"]}
        if not limit:
            return page
        if state["data"] != self.data:
            self.data, self.groups, self.kept = state["data"], self._row_groups(pads.dataset(path, filesystem=store, format="parquet")), {}
        found, rows = [], 0
        # Row groups come by their least key: those that end before the page are passed over, and what a page does not reach is not read.
        ahead = [g for g in self.groups if g[1] > after]
        self.kept = {k: kept for k, kept in self.kept.items() if any(k[0] == g[2] for g in ahead)}
        for least, _, number, fragment in ahead:
            if rows > limit and least > max(t.column("id")[min(limit, t.num_rows - 1)].as_py() for t in found):
                break
            key = (number, since)
            if key not in self.kept:
                self.kept[key] = self._read(fragment, since)
            keys, items = self.kept[key]
            start = int(np.searchsorted(keys, after, side="right"))
            part = items.slice(start, limit + 1)
            if part.num_rows:
                found.append(part)
                rows += part.num_rows
        if not found:
            return page
        items = found[0] if len(found) == 1 else pa.concat_tables(found).sort_by("id")
        taken = items.slice(0, limit).to_pylist()
        return page | {"items": [tuple(r.values()) for r in taken], "next": taken[-1]["id"] if rows > limit else None}

    @staticmethod
    def _row_groups(table: pads.Dataset) -> list[tuple]:
        """(least key, greatest key, number, fragment) of every row group; one without statistics can hold any key."""
        found = []
        for fragment in table.get_fragments():
            for group in fragment.split_by_row_group():
                bounds = (group.row_groups[0].statistics or {}).get("id", {"min": -(1 << 63), "max": 1 << 63})
                found.append((bounds["min"], bounds["max"], len(found), group))
        return sorted(found, key=lambda g: g[:3])

    @staticmethod
    def _read(fragment: pads.Fragment, since: str | None) -> tuple[np.ndarray, pa.Table]:
        """(keys, items) of a row group that changed at ``since`` or later, by key."""
        wanted, schema = pads.field("id").is_valid(), fragment.physical_schema
        if since:
            moment = datetime.datetime.fromisoformat(since)
            moment = moment.astimezone(datetime.UTC) if moment.tzinfo else moment.replace(tzinfo=datetime.UTC)
            wanted &= pads.field("changed_at") >= (moment if schema.field("changed_at").type.tz else moment.replace(tzinfo=None))
        items = fragment.to_table(filter=wanted).sort_by("id")
        # Spark writes instants in UTC, in older files without saying so.
        for k, f in enumerate(items.schema):
            if pa.types.is_timestamp(f.type):
                items = items.set_column(k, f.name, items.column(k).cast(pa.timestamp("us", f.type.tz), safe=False).cast(pa.timestamp("us", "UTC")))
        return items.column("id").to_numpy(), items


def write_feed(rows: DataFrame, folder: str, version: str, server_time: datetime.datetime) -> None:
    """Makes ``rows`` (id, changed_at, ...) the state that the feed in ``folder`` gives from now on."""
    register(rows.sparkSession)
    data = f"data-{uuid.uuid4().hex}"
    rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{folder}/{data}")
    last = rows.agg(F.max("id")).first()[0] or 0
    with blobs.create(f"{folder}/feed.json") as f:
        f.write(json.dumps({"data": data, "version": version, "server_time": server_time.isoformat(), "last": last}).encode())


# ---- pages ---------------------------------------------------------------------------------------------------------


class Pages:
    """The pages of one read."""

    def __init__(self, fetch: Callable[[int, str | None, int], dict], version: str, page_size: int):
        self.fetch, self.version, self.page_size = fetch, version, page_size

    def rows(self, after: int, until: int, since: str | None) -> Iterator[tuple]:
        """Items of keys above ``after`` up to ``until``; the first column is the key."""
        while True:
            page = self.fetch(after, since, self.page_size)
            if page["version"] != self.version:
                raise VersionMoved(f"version {page['version']} in place of {self.version}")
            for item in page["items"]:
                if item[0] > until:
                    return
                yield item
            following = page["next"]
            if following is None or following >= until:
                return
            if following <= after:
                raise FeedFailed("a page came twice")
            after = following


@dataclass
class KeyRange(InputPartition):
    after: int
    until: int
    since: str | None
    version: str
    pull: str

    def __post_init__(self):
        self.value = (self.after, self.until)


class _Feed:
    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.fieldNames(), options
        self.page_size, self.parts = int(options.get("page_size", PAGE_SIZE)), int(options.get("partitions", PARTITIONS))

    def client(self):
        module, _, name = self.options.get("client", f"{__name__}:FolderFeed").partition(":")
        return getattr(importlib.import_module(module), name)(self.options["path"])

    def head(self) -> dict:
        return self.client().fetch(0, None, 0)

    def ranges(self, last: int, since: str | None, version: str, pull: str) -> list[KeyRange]:
        step = max(1, -(-last // self.parts))
        # What has a key above the last one came after planning; the last range takes it in.
        ends = [*range(step, step * self.parts, step), 1 << 62]
        return [KeyRange(a, b, since, version, pull) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def read(self, part: KeyRange) -> Iterator[tuple]:
        marked = "pull" in self.names
        if marked and part.after == 0:
            yield (*[None] * (len(self.names) - 1), part.pull)  # says what kind of pull this is, also when nothing comes
        for row in Pages(self.client().fetch, part.version, self.page_size).rows(part.after, part.until, part.since):
            yield (*row, part.pull) if marked else row


class FeedReader(_Feed, DataSourceReader):
    def partitions(self) -> list[KeyRange]:
        head = self.head()
        return self.ranges(head["last"], self.options.get("since"), head["version"], "changes" if self.options.get("since") else "full")


class FeedStreamReader(_Feed, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"since": None, "version": None, "last": 0}

    def latestOffset(self) -> dict:
        head = self.head()
        return {"since": head["server_time"], "version": head["version"], "last": head["last"]}

    def partitions(self, start: dict, end: dict) -> list[KeyRange]:
        whole = start["version"] != end["version"]
        return self.ranges(end["last"], None if whole else start["since"], end["version"], "full" if whole else "changes")

    def commit(self, end: dict) -> None:
        pass


class StockFeed(DataSource):
    """``spark.read.format("stock_feed")``, with the schema of the items (the key first; a last column ``pull`` tells full pulls).
    Options: path; client (``module:class`` made from the path); page_size; partitions; since (batch)."""

    @classmethod
    def name(cls) -> str:
        return "stock_feed"

    def schema(self) -> str:
        raise ValueError("give the items' schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FeedStreamReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StockFeed)


# ---- pulls ---------------------------------------------------------------------------------------------------------


def plan(since: datetime.datetime | None, last_success: datetime.datetime | None, last_repair: datetime.datetime | None, now: datetime.datetime) -> tuple[str, datetime.datetime | None]:
    """(mode, since) of the next pull: in full without a state or where the feed no longer accepts ``since``; once a day from a day
    further back, which repairs what was missed; else what changed."""
    if since is None or last_success is None or now - last_success > FULL_AFTER:
        return "full", None
    due = datetime.datetime.combine(now.date(), REPAIR_AT, now.tzinfo)
    if now >= due and (last_repair is None or last_repair < due):
        return "day", since - REPAIR_BACK
    return "changes", since


def _moved(error: Exception) -> bool:
    return "VersionMoved" in str(error)


def read_feed(spark: SparkSession, path: str, schema: str, since: datetime.datetime | None = None, tries: int = 3, **options) -> DataFrame:
    """The items of a feed, read and kept; begun anew, in full, if the version moves meanwhile."""
    register(spark)
    for left in range(tries - 1, -1, -1):
        reader = spark.read.format("stock_feed").schema(schema).options(path=path, **options)
        try:
            return materialize((reader.option("since", since.isoformat()) if since else reader).load(), "feed")
        except Exception as error:
            if not left or not _moved(error):
                raise
            since = None
    raise AssertionError


def pull_stream(spark: SparkSession, path: str, schema: str, state: str, tries: int = 3, **options) -> DataFrame:
    """Pulls what the feed in ``path`` has into the table kept below ``state``: (items, withdrawn).

    ``schema``: id, changed_at and values.  A full pull withdraws what it does not see."""
    from partmill.streaming.kept import KeptTable
    from partmill.streaming.stock import apply_pull

    register(spark)
    table = KeptTable(spark, f"{state}/items", f"{schema}, withdrawn boolean", ["id"])

    def take(batch: DataFrame, number: int) -> None:
        batch = materialize(batch, "feed-pull")
        full = not batch.where("id is null and pull = 'full'").isEmpty()
        items = batch.where("id is not null").drop("pull")
        stored = table.read() if full else table.near(items)
        rows = apply_pull(stored, items, "id", ["changed_at"], full=full)
        keys = rows.select("id") if full else items.select("id")
        table.replace(number, keys, rows if full else rows.join(keys.distinct(), "id", "left_semi"))

    stream = lambda: spark.readStream.format("stock_feed").schema(f"{schema}, pull string").options(path=path, **options).load()
    for left in range(tries - 1, -1, -1):
        try:
            stream().writeStream.foreachBatch(take).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
            break
        except Exception as error:
            if not left or not _moved(error):
                raise
    return table.read()

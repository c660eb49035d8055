"""Delivery to sinks: windows handed to a function and committed after it, and Structured Streaming over a table's change feed.

At least once: the cursor moves only when the sink's function has returned. Sinks should be idempotent by (consumer, snapshot_id, table_id, rowid,
change_type).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ebbtide import errors
from ebbtide.sources.lake import Lake, Transaction
from ebbtide.streaming.cdc import MAX_SNAPSHOTS, Cdc


@dataclass
class Batch:
    """Rows of snapshots start to end. commit() moves the cursor to end: to what was handed over, never to what came later."""

    consumer: Consumer
    rows: DataFrame
    start: int
    end: int

    def commit(self) -> None:
        self.consumer.cdc.cdc_commit(self.consumer.catalog, self.consumer.name, self.end)

    @contextmanager
    def transaction(self, lake: Lake, **about) -> Iterator[Transaction]:
        """A transaction of a lake for what the batch makes, and the commit of the batch after it. A crash between the two is made up
        for by Consumer.recover()."""
        with lake.transaction(extra=self.mark, **about) as tx:
            yield tx
        self.commit()

    @property
    def mark(self) -> str:
        return f"{self.consumer.catalog}.{self.consumer.name}:{self.start}:{self.end}"


class Consumer:
    """A consumer as an object: made where it isn't there, read in batches, released at the end.

    on_exists: "use" goes on where it stands, "replace" drops it first, "error" refuses."""

    def __init__(self, cdc: Cdc, catalog: str, name: str, kind: str = "dml_changes", on_exists: str = "use", **create):
        if on_exists not in ("use", "replace", "error"):
            raise ValueError("on_exists is use, replace or error")
        self.cdc, self.catalog, self.name, self.kind = cdc, catalog, name, kind
        there = name in {r.consumer_name for r in cdc.cdc_list_consumers(catalog).select("consumer_name").collect()}
        if there and on_exists == "replace":
            cdc.cdc_consumer_drop(catalog, name)
            there = False
        if not there or on_exists == "error":
            getattr(cdc, f"cdc_{kind[:3]}_consumer_create")(catalog, name, **create)

    def __enter__(self) -> Consumer:
        return self

    def __exit__(self, *_) -> None:
        with suppress(errors.Busy):
            self.cdc.cdc_consumer_release(self.catalog, self.name)

    def next(self, timeout_ms: int = 0, max_snapshots: int = MAX_SNAPSHOTS) -> Batch | None:
        """The next batch; None if nothing came within the time. Empty windows are passed over."""
        while True:
            before = self.cdc.cursor(self.catalog, self.name)
            rows, window = self.cdc.next_window(self.catalog, self.name, self.kind, timeout_ms, max_snapshots)
            if window is not None:
                return Batch(self, rows, window.start_snapshot, window.end_snapshot)
            if self.cdc.cursor(self.catalog, self.name) == before:
                return None

    def batches(self, timeout_ms: int = 0, max_snapshots: int = MAX_SNAPSHOTS) -> Iterator[Batch]:
        """Batches until nothing comes; a batch that was not committed comes again."""
        while (b := self.next(timeout_ms, max_snapshots)) is not None:
            yield b

    def recover(self, lake: Lake) -> None:
        """Commits what transactions of this consumer's batches have brought into the lake without a commit after it."""
        start = f"{self.catalog}.{self.name}:"
        ends = [int(r["commit_extra_info"].rpartition(":")[2]) for r in lake.refresh()._state["changes"] if (r["commit_extra_info"] or "").startswith(start)]
        if max(ends, default=-1) > self.cdc.cursor(self.catalog, self.name):
            self.window()  # takes the lease
            self.cdc.cdc_commit(self.catalog, self.name, max(ends))

    def window(self, max_snapshots: int = MAX_SNAPSHOTS):
        return self.cdc.cdc_window(self.catalog, self.name, max_snapshots).first()

    def successor(self, name: str, **create) -> Consumer:
        """The consumer that goes on where this one met a change of its table's shape."""
        at = self.window().terminal_at_snapshot
        if at is None:
            raise ValueError(f"consumer {self.name} has met no shape change")
        subs = self.cdc.cdc_list_subscriptions(self.catalog, self.name).collect()
        create = {"table_id": subs[0].table_id, "change_types": sorted({s.change_type for s in subs})} | create
        return Consumer(self.cdc, self.catalog, name, self.kind, start_at=str(at), **create)


def drain(cdc: Cdc, catalog: str, name: str, sink: Callable[[DataFrame, int, int], None], kind: str = "dml_changes", max_snapshots: int = MAX_SNAPSHOTS, timeout_ms: int = 0) -> int:
    """Hands one window after another to sink(rows, start, end) and commits each after it; ends when nothing is there. Returns the windows handed over."""
    n = 0
    for b in Consumer(cdc, catalog, name, kind).batches(timeout_ms, max_snapshots):
        sink(b.rows, b.start, b.end)
        b.commit()
        n += 1
    return n


@dataclass
class Stage:
    """Takes the changes of `source` through apply(batch, transaction) into the lake; its consumer has the stage's name."""

    name: str
    source: str
    apply: Callable[[Batch, Transaction], None]
    change_types: list[str] | None = None


def run_stages(cdc: Cdc, lake: Lake, stages: list[Stage], max_snapshots: int = MAX_SNAPSHOTS) -> dict[str, int]:
    """Runs a graph of stages over the tables of one lake until all are quiet: what one stage writes, another may read. Each batch is one
    snapshot, marked with the batch it is of, so that a batch whose snapshot is there is not applied again. Returns batches by stage."""
    consumers = {s.name: Consumer(cdc, lake.name, s.name, table_name=s.source, start_at="beginning", change_types=s.change_types) for s in stages}
    for c in consumers.values():
        c.recover(lake)
    done = dict.fromkeys(consumers, 0)
    moved = True
    while moved:
        moved = False
        for s in stages:
            for b in consumers[s.name].batches(0, max_snapshots):
                with b.transaction(lake) as tx:
                    s.apply(b, tx)
                done[s.name] += 1
                moved = True
    for c in consumers.values():
        c.__exit__()
    return done


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class SnapshotStream(DataSource):
    """Format "ebbtide_snapshots": a stream of snapshot numbers of a lake's log (option path), one row for each new log entry, with its change map
    as JSON. Offsets are log numbers, so Spark's own checkpoint keeps the place; foreachBatch reads the rows of the range from the lake."""

    @classmethod
    def name(cls) -> str:
        return "ebbtide_snapshots"

    def schema(self) -> str:
        return "snapshot_id long, changes string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], int(self.options.get("maxentries", 1000)))


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most
        self.at = 0

    def _entries(self):
        """The store, and the names in the log folder; any store that Arrow reaches, as the reader runs outside the JVM."""
        from pyarrow import fs

        path = self.path.replace("s3a://", "s3://", 1)
        path = path if "://" in path else "file://" + path.removeprefix("file:")
        store, root = fs.FileSystem.from_uri(path)
        return store, sorted(f.path for f in store.get_file_info(fs.FileSelector(f"{root.rstrip('/')}/_log")) if f.path.endswith(".json"))

    def initialOffset(self) -> dict:
        return {"log": 0}

    def latestOffset(self) -> dict:
        self.at = max(self.at, min(len(self._entries()[1]), self.at + self.most))
        return {"log": self.at}

    def partitions(self, start: dict, end: dict):
        self.at = max(self.at, end["log"])
        return [_Range(start["log"], end["log"])]

    def read(self, partition: _Range):
        import json

        store, paths = self._entries()
        for path in paths[partition.lo : partition.hi]:
            with store.open_input_stream(path) as f:
                for op in json.loads(f.read())["ops"]:
                    if op["op"] == "add" and op["frame"] == "changes":
                        yield op["row"]["snapshot_id"], json.dumps(op["row"]["changes"])

    def commit(self, end: dict) -> None:
        pass

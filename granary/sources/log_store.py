"""A log store as a data source: range queries by windows of time as tasks, pages inside a window, a stream whose offsets are times."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "at long, level string, source string, service_name string, message string, labels map<string, string>"
# Labels behind the columns, and what stands for a missing one.
LABELS = {"level": ("level", "INFO"), "source": ("container", "unknown"), "service_name": ("service", "unknown")}


@dataclass
class Window(InputPartition):
    """The lines of [start, end), in nanoseconds."""

    start: int
    end: int


def lines(base: str, selector: str, start: int, end: int, page: int = 1000, get=None) -> Iterator[tuple[int, dict[str, str], str]]:
    """(time, labels, line) of [start, end), oldest first, by pages of at most `page` lines.

    The next page begins at the last time seen, as more lines may have that time; those that were already taken are left out by their number. If a whole page has one time, a page of twice as
    many lines is asked for, so no line is lost.
    """

    def fetch(url: str) -> str:
        with urlopen(url, timeout=30) as r:  # noqa: S310  the address is the caller's
            return r.read().decode()

    at, taken, size = start, 0, page
    while at < end:
        reply = json.loads((get or fetch)(f"{base}/loki/api/v1/query_range?" + urlencode({"query": selector, "start": at, "end": end, "limit": size, "direction": "forward"})))
        if reply.get("status") != "success":
            raise RuntimeError(f"the log store says {reply.get('status', 'nothing')}"[:500])
        own = sorted(((int(t), json.dumps(s["stream"], sort_keys=True), line) for s in reply["data"]["result"] for t, line in s["values"]))
        for t, labels, line in own[taken:]:
            yield t, json.loads(labels), line
        if len(own) < size:
            return
        last = own[-1][0]
        if last == at:
            # the page has one time only: all of it is taken once a larger one has been read
            taken, size = len(own), size * 2
        else:
            at, taken, size = last, sum(t == last for t, _, _ in own), page


class _Store:
    def __init__(self, options: dict[str, str]):
        self.base, self.topic = options["url"], options.get("topic", "")
        self.page, self.tasks = int(options.get("page", 1000)), int(options.get("tasks", 4))
        self.match = {"job": self.topic} if self.topic else {}

    def selector(self) -> str:
        return "{" + ", ".join(f'{k}={json.dumps(v)}' for k, v in sorted(self.match.items())) + "}"

    def windows(self, start: int, end: int) -> list[Window]:
        step = max(1, -(-(end - start) // self.tasks))
        return [Window(s, min(s + step, end)) for s in range(start, end, step)]

    def read(self, partition: Window) -> Iterator[tuple]:
        for t, labels, line in lines(self.base, self.selector(), partition.start, partition.end, self.page):
            yield (t, *[labels.get(k, d) for k, d in LABELS.values()], line, labels)


class LogReader(_Store, DataSourceReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.start, self.end = int(options["start"]), int(options["end"])

    def partitions(self) -> list[Window]:
        return self.windows(self.start, self.end) if self.start < self.end else [Window(0, 0)]


class PushingLogReader(LogReader):
    """Filters on time narrow the range, equal labels go into the selector; Spark applies nothing that was pushed again, as the store does it exactly."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute[0] in LABELS and len(f.attribute) == 1 and f.value != LABELS[f.attribute[0]][1]:
                name = LABELS[f.attribute[0]][0]
                if self.match.setdefault(name, f.value) != f.value:
                    yield f
            elif getattr(f, "attribute", None) == ("at",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.start = max(self.start, f.value + isinstance(f, GreaterThan))
            elif getattr(f, "attribute", None) == ("at",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.end = min(self.end, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f


class LogStreamReader(_Store, DataSourceStreamReader):
    """Offsets are times. A micro-batch takes at most `step` nanoseconds, up to `delay` before now (lines that come later than that are not seen) or to `end`."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.start, self.step = int(options["start"]), int(options.get("step", 3600 * 10**9))
        self.end, self.delay = int(options.get("end", 0)), int(options.get("delay", 5 * 10**9))
        self.latest = self.start

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        newest = self.end or time.time_ns() - self.delay
        self.latest = max(self.latest, min(self.latest + self.step, newest))
        return {"at": self.latest}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        # after a restart the offsets of the checkpoint tell where to go on
        self.latest = max(self.latest, end["at"])
        return self.windows(start["at"], end["at"])

    def commit(self, end: dict) -> None:
        """Nothing to do: the store keeps its lines."""


class LogStore(DataSource):
    """spark.read or spark.readStream.format("log_store") with the options url, topic, start and end (nanoseconds), page, tasks, push, and for streams step and delay.

    push tells that spark.sql.python.filterPushdown.enabled is set, without which Spark takes no reader that can push; see log_lines.
    """

    @classmethod
    def name(cls) -> str:
        return "log_store"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PushingLogReader if self.options.get("push") == "true" else LogReader)(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return LogStreamReader(dict(self.options))


def log_lines(spark: SparkSession, url: str, topic: str, start: int, end: int, **options: object) -> DataFrame:
    """The lines of a topic in [start, end), with filters pushed to the store if the session lets Python sources take them."""
    spark.dataSource.register(LogStore)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    return spark.read.format("log_store").options(url=url, topic=topic, start=start, end=end, push=push, **options).load()

"""A paged external index as a Spark data source, by a backend that callers supply.

The backend is any picklable object with fetch(kind, params) -> (status, retry_after, body): kind
is by_date, by_modified, by_registration or one. 204 is an empty answer, 401 and 403 end the
read, 429 and 5xx are tried again. Each partition is one window of dates and follows its markers,
so windows are read in parallel, as many at a time as the cluster has room for. Filters on the windows' dates
choose the windows, so that the others are never asked for; a registration, given as an option, is one request
of its own, whose rows have no window.
"""

from __future__ import annotations

import datetime as dt
import json
import operator
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as S
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from corvane.operators.normalizing import next_marker, unwrap

RETRIED = (429, 500, 502, 503, 504)
WINDOW_DAYS, OVERLAP_DAYS = 90, 7
#: Set it to have filters reach the source; a session without it reads all windows and filters them.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_TESTS = {
    S.EqualTo: operator.eq, S.GreaterThan: operator.gt, S.GreaterThanOrEqual: operator.ge,
    S.LessThan: operator.lt, S.LessThanOrEqual: operator.le, S.In: lambda day, days: day in days,
}
SCHEMA = "window_start date, window_end date, page int, marker string, payload string"


class FatalAnswer(RuntimeError):
    """The backend refuses the reader."""


def fetch(backend, kind: str, params: dict, retries: int = 3, pause=time.sleep):
    """The body of one request, or None if there is none."""
    for attempt in range(retries + 1):
        status, after, body = backend.fetch(kind, params)
        if status == 204:
            return None
        if status in (401, 403):
            raise FatalAnswer(f"status {status}")
        if status in RETRIED and attempt < retries:
            pause(min(30.0, float(after) if after else 2.0**attempt))
            continue
        if status >= 400:
            raise RuntimeError(f"status {status} for {kind}")
        return body


def windows(start: dt.date, end: dt.date, days: int = WINDOW_DAYS) -> list[tuple[dt.date, dt.date]]:
    """Consecutive windows of at most `days` days, both ends included."""
    out = []
    while start <= end:
        stop = min(end, start + dt.timedelta(days=days - 1))
        out.append((start, stop))
        start = stop + dt.timedelta(days=1)
    return out


def next_window(last_end: dt.date | None, failed: tuple[dt.date, dt.date] | None, today: dt.date, incremental: bool, start: dt.date, overlap: int = OVERLAP_DAYS) -> tuple[dt.date, dt.date] | None:
    """Where a feed goes on: a failed window again; else after the last completed one, or `overlap` days before its end."""
    if failed:
        return failed
    if last_end is None:
        begin = start
    else:
        begin = last_end - dt.timedelta(days=overlap) if incremental else last_end + dt.timedelta(days=1)
    return (begin, today) if begin <= today else None


def pages(backend, kind: str, start: dt.date | None, end: dt.date | None, retries: int = 3, registration: str | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA until there is no marker or no record."""
    marker, number = None, 0
    asked = {"registration": registration} if registration else {"start_date": start.isoformat(), "end_date": end.isoformat()}
    while True:
        body = fetch(backend, kind, asked | {"marker": marker}, retries)
        found = unwrap(body)
        if found:
            yield (start, end, number, marker, json.dumps(body))
        marker, number = next_marker(body), number + 1
        if not marker or not found:
            return


@dataclass
class _Window(InputPartition):
    start: dt.date | None
    end: dt.date | None


class _Reader(DataSourceReader):
    def __init__(self, source):
        self.source, self.kept = source, []

    def partitions(self):
        s = self.source
        if s.registration:
            return [_Window(None, None)]
        return [w for w in (_Window(a, b) for a, b in windows(s.start, s.end, s.days)) if all(test(getattr(w, end), value) for end, test, value in self.kept)]

    def read(self, partition):
        s = self.source
        if partition is None:  # no window is left
            return
        yield from pages(s.backend, s.kind, partition.start, partition.end, registration=s.registration)


class _FilteredReader(_Reader):
    """Takes comparisons of the windows' dates, which hold or fail for a window as a whole; gives all others back."""

    def pushFilters(self, filters):
        for f in filters:
            end = {("window_start",): "start", ("window_end",): "end"}.get(getattr(f, "attribute", None))
            values = f.value if isinstance(f, S.In) else (getattr(f, "value", None),)
            if end and type(f) in _TESTS and all(isinstance(v, dt.date) for v in values) and not self.source.registration:
                self.kept.append((end, _TESTS[type(f)], f.value))
            else:
                yield f


class _StreamReader(DataSourceStreamReader):
    """The windows up to the last day, each read by a task; the offset is the next day, kept by the checkpoint."""

    def __init__(self, source):
        self.source = source

    def initialOffset(self):
        return {"next": self.source.start.isoformat()}

    def latestOffset(self):
        return {"next": (self.source.end + dt.timedelta(days=1)).isoformat()}

    def partitions(self, start, end):
        begin, stop = dt.date.fromisoformat(start["next"]), dt.date.fromisoformat(end["next"]) - dt.timedelta(days=1)
        return [_Window(a, b) for a, b in windows(begin, stop, self.source.days)]

    def read(self, partition):
        yield from pages(self.source.backend, self.source.kind, partition.start, partition.end)


def source_of(backend, name: str = "case_pages") -> type[DataSource]:
    """A data source class to register: options kind, start, end, days; registration in place of dates; push, to take filters."""

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return name

        def __init__(self, options):
            super().__init__(options)
            self.backend = backend
            self.registration = options.get("registration")
            self.kind = "by_registration" if self.registration else options.get("kind", "by_date")
            self.start, self.end = (None, None) if self.registration else (dt.date.fromisoformat(options[k]) for k in ("start", "end"))
            self.push = options.get("push", "false").lower() == "true"
            self.days = int(options.get("days", WINDOW_DAYS))

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return _FilteredReader(self) if self.push else _Reader(self)

        def streamReader(self, schema):
            return _StreamReader(self)

    return Pages


def read(spark: SparkSession, start: dt.date | None = None, end: dt.date | None = None, kind: str = "by_date", days: int = WINDOW_DAYS, registration: str | None = None, name: str = "case_pages") -> DataFrame:
    """The pages of a registered source, by dates or by registration; filters reach it where the session lets them."""
    options = {"registration": registration} if registration else {"kind": kind, "start": start.isoformat(), "end": end.isoformat(), "days": str(days)}
    return spark.read.format(name).options(push=spark.conf.get(PUSHDOWN, "false"), **options).load()

"""A portal's event feed as a data source, which sends filters along with its requests (survey S16)."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThan

SCHEMA = "EventId long, EventBodyName string, EventDate string, EventAgendaFile string, EventMinutesFile string, EventInSiteURL string"
# The feed's page size and time limit.
MOST, SECONDS = 500, 30


@dataclass
class Page(InputPartition):
    """One request."""

    url: str


class EventReader(DataSourceReader):
    """Equal bodies and bounds of the date go to the feed; other filters stay with the engine."""

    def __init__(self, base: str, most: int):
        self.base, self.most, self.sent = base, most, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            quoted = str(f.value).replace("'", "''") if hasattr(f, "value") else ""
            if isinstance(f, EqualTo) and f.attribute == ("EventBodyName",):
                self.sent.append(f"EventBodyName eq '{quoted}'")
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("EventDate",):
                self.sent.append(f"EventDate ge datetime'{quoted}'")
            elif isinstance(f, LessThan) and f.attribute == ("EventDate",):
                self.sent.append(f"EventDate lt datetime'{quoted}'")
            yield f  # the feed may answer with more than was asked for

    def partitions(self) -> list[InputPartition]:
        asked = {"$filter": " and ".join(self.sent)} if self.sent else {}
        return [Page(f"{self.base}/Events?{urlencode(asked | {'$orderby': 'EventDate desc', '$top': str(self.most)})}")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with urlopen(Request(partition.url, headers={"Accept": "application/json"}), timeout=SECONDS) as answer:
            rows = json.load(answer)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for row in rows if isinstance(rows, list) else []:
            yield tuple(row.get(n) for n in names)


class EventFeed(DataSource):
    """`spark.read.format("event_feed").option("base", ...)`."""

    @classmethod
    def name(cls) -> str:
        return "event_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EventReader:
        return EventReader(self.options["base"].rstrip("/"), int(self.options.get("most", MOST)))


def events(spark: SparkSession, base: str, body: str, year: int):
    """A body's events of a year, latest first, as many as the feed gives at once."""
    spark.dataSource.register(EventFeed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("event_feed").option("base", base).load()
    some = rows.filter((rows.EventBodyName == body) & (rows.EventDate >= f"{year}-01-01T00:00:00") & (rows.EventDate < f"{year + 1}-01-01T00:00:00"))
    return some.orderBy(some.EventDate.desc(), "EventId")

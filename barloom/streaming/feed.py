"""A feed of frames as a stream: asks again after it was cut, says where it was, and leaves frames as text for ``venues.frames``."""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from barloom.errors import ConfigError, VenueError

SCHEMA = "place long, kind string, value string"
LEAST_WAIT, MOST_WAIT = 0.25, 30.0


def backoff(attempt: int) -> float:
    """Seconds before an attempt (from 1 on) to connect again: doubled each time, up to a limit."""
    return min(MOST_WAIT, LEAST_WAIT * 2 ** (attempt - 1))


class FeedReader(SimpleDataSourceStreamReader):
    """Rows of kind frame (a text as it came) or gap (the connection was lost before this place).

    ``source`` names what reads (``module:function``, given the url and a place, returning the frames from there on; it raises ConnectionError
    when it is cut). A place is the number of frames read, which the checkpoint keeps, so a restart goes on where it was. Where the connection was lost and no
    frame has come since, the offset counts these cuts too, as it must differ from the one before if there are rows.
    """

    def __init__(self, options: dict[str, str], sleep: Callable[[float], None] = time.sleep):
        parts = urlsplit(options["url"])
        if parts.username or parts.password:
            raise ConfigError("the address of a feed must not hold credentials")
        module, _, name = options["source"].partition(":")
        self.url, self.receive = options["url"], getattr(importlib.import_module(module), name)
        self.attempts, self.sleep = int(options.get("attempts", "8")), sleep

    def initialOffset(self) -> dict:
        return {"place": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, place = [], start["place"]
        for attempt in range(1, self.attempts + 1):
            try:
                for text in self.receive(self.url, place):
                    rows.append((place, "frame", text))
                    place += 1
                if place > start["place"]:
                    return iter(rows), {"place": place}
                return iter(rows), {"place": place, "cuts": start.get("cuts", 0) + len(rows)} if rows else start
            except ConnectionError:
                rows.append((place, "gap", None))
                self.sleep(backoff(attempt))
        raise VenueError(f"{self.url} was cut {self.attempts} times")

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """After a failure: the same frames again, however many answers they take; of cuts only those behind the last frame are known any more."""
        place, attempt = start["place"], 0
        while place < end["place"]:
            before = place
            try:
                for text in self.receive(self.url, place):
                    yield place, "frame", text
                    place += 1
                    if place == end["place"]:
                        break
            except ConnectionError:
                pass
            # An answer that brings nothing on is one like a cut: these frames have been there.
            attempt = attempt + 1 if place == before else 0
            if attempt == self.attempts:
                raise VenueError(f"{self.url} did not give frames {place} to {end['place']} again")
            if attempt:
                self.sleep(backoff(attempt))
        for _ in range(start.get("cuts", 0) if start["place"] == place else 0, end.get("cuts", 0)):
            yield place, "gap", None


class FeedSource(DataSource):
    """``spark.readStream.format("feed")`` with options url and source."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> FeedReader:
        return FeedReader(self.options)

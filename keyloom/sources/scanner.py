"""A block scanner as a Python data source: any reader of block ranges becomes a stream, in chunks that adapt to hits.

The network side is a callable; here logs in files can play it. Offsets are blocks, so a restart goes on where it was."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Least chunk of blocks, and how far a restart goes back.
LEAST_CHUNK, STEP_BACK = 100, 10

Fetch = Callable[[int, int], Iterable[tuple]]


def next_chunk(size: int, hits: int, largest: int) -> int:
    """Blocks to scan next: the least number after hits, else twice as many, within the limits."""
    return max(LEAST_CHUNK, min(largest, LEAST_CHUNK if hits else 2 * size))


def fetch_range(fetch: Fetch, start: int, end: int, tries: int = 8) -> tuple[int, list[tuple]]:
    """Rows of blocks start..end; after an error the range is halved. Gives the last block that was read."""
    for attempt in range(tries):
        try:
            return end, list(fetch(start, end))
        except (OSError, ValueError):
            if attempt == tries - 1:
                raise
            end = start + (end - start) // 2
    raise AssertionError


def resume_from(last_scanned: int | None, first: int) -> int:
    """Where a scan starts: a few blocks before the last one scanned; repeats are left to the ledger's dedup."""
    return first if last_scanned is None else max(first, last_scanned - STEP_BACK)


def block_source(fetch: Fetch, newest: Callable[[], int], schema: str, first: int = 0, largest: int = 10_000) -> type[DataSource]:
    """A data source class to register with spark.dataSource; its rows are those of fetch."""

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self) -> None:
            self.size = LEAST_CHUNK

        def initialOffset(self) -> dict:
            return {"block": first}

        def read(self, start: dict):
            at, end = start["block"], newest()
            if at > end:
                return iter(()), start
            last, rows = fetch_range(fetch, at, min(end, at + self.size - 1))
            self.size = next_chunk(self.size, len(rows), largest)
            return iter(rows), {"block": last + 1}

        def readBetweenOffsets(self, start: dict, end: dict):
            return iter(list(fetch(start["block"], end["block"] - 1)))

        def commit(self, end: dict) -> None: ...

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "blocks"

        def schema(self) -> str:
            return schema

        def simpleStreamReader(self, schema):
            return Reader()

    return Source



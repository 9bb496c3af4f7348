"""A data source of JSON addresses: read in parallel, tried again, failures kept as rows.

``spark.dataSource.register(HttpJson)``, then ``spark.read.format("http_json")`` with
the options ``addresses`` (one a line), ``parallel`` (partitions), ``attempts``,
``timeout`` (seconds) and ``pause`` (seconds before the second attempt, doubled after).
For a table of addresses use :func:`fetched`, whose requests follow its partitions.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, status int, body string, error string, attempts int"


def fetch(url: str, attempts: int = 3, timeout: float = 30, pause: float = 0.5) -> tuple[str, int | None, str | None, str | None, int]:
    """A row of SCHEMA: the body only of an answer 200 that is JSON.

    Connection errors and answers 429 and 5xx are tried again; any other outcome is
    a row with its status and what was wrong, never an exception.
    """
    status, error = None, None
    for attempt in range(1, attempts + 1):
        try:
            with urlopen(Request(url, headers={"Accept": "application/json"}), timeout=timeout) as answer:
                status, text = answer.status, answer.read().decode("utf-8-sig")
            json.loads(text)
            return url, status, text, None, attempt
        except HTTPError as e:
            status, error = e.code, f"HTTP {e.code}"
            if e.code != 429 and e.code < 500:
                break
        except ValueError as e:
            error = f"no JSON: {e}" if status == 200 else str(e)
            break
        except OSError as e:
            status, error = None, str(e)
        if attempt < attempts:
            time.sleep(pause * 2 ** (attempt - 1))
    return url, status, None, error, attempt


class Some(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = list(dict.fromkeys(u.strip() for u in options.get("addresses", "").splitlines() if u.strip()))
        self.parallel = int(options.get("parallel", 8))
        self.rules = int(options.get("attempts", 3)), float(options.get("timeout", 30)), float(options.get("pause", 0.5))

    def partitions(self) -> list[Some]:
        n = max(1, min(self.parallel, len(self.urls)))
        return [Some(self.urls[k::n]) for k in range(n)]

    def read(self, partition: Some) -> Iterator[tuple]:
        for url in partition.urls:
            yield fetch(url, *self.rules)


class HttpJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def fetched(addresses: DataFrame, url: str = "url", attempts: int = 3, timeout: float = 30, pause: float = 0.5) -> DataFrame:
    """Rows of SCHEMA for a table of addresses; write them before using them twice, or they are asked again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fetch(u, attempts, timeout, pause) for u in batch.column(0).to_pylist()]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32())
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["url", "status", "body", "error", "attempts"])

    return addresses.select(url).where(f"`{url}` is not null").distinct().mapInArrow(run, SCHEMA)

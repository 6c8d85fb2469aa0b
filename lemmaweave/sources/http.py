"""Texts over HTTP as a Spark data source."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TIMEOUT_S = 30


def fetch(url: str) -> tuple[str, str | None, str | None]:
    """url, text and error. A body that is not UTF-8, or a failed request, is an error and not a broken job."""
    try:
        with urllib.request.urlopen(url, timeout=TIMEOUT_S) as r:  # noqa: S310
            return url, r.read().decode(), None
    except UnicodeDecodeError:
        return url, None, "invalid UTF-8"
    except (urllib.error.URLError, OSError, ValueError) as e:
        return url, None, str(e)


class _Url(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls

    def partitions(self) -> list[_Url]:
        return [_Url(u) for u in self.urls]

    def read(self, partition: _Url) -> Iterator[tuple]:
        yield fetch(partition.url)


class HttpTexts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lemmaweave_http"

    def schema(self) -> str:
        return "doc_id string, text string, error string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader([u.strip() for u in self.options.get("urls", "").splitlines() if u.strip()])

"""Interfaces for what lies outside: paper indexes, policies, page and PDF fetchers. Offline stand-ins need no network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol, TypeVar

from pyspark.sql import DataFrame

from ..operators.retrieval import search, snippets

T = TypeVar("T")


class PaperIndex(Protocol):
    def search(self, queries: DataFrame, limit: int) -> DataFrame: ...
    def snippets(self, needle: str) -> DataFrame: ...


class LocalIndex:
    """A table of papers as index."""

    def __init__(self, papers: DataFrame):
        self.papers = papers

    def search(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        return search(queries, self.papers, limit)

    def snippets(self, needle: str) -> DataFrame:
        return snippets(self.papers, needle)


class Policy(Protocol):
    """Chooses the next action of a trajectory; offline: recorded actions for evaluation.replay."""

    def act(self, history: list[dict]) -> dict: ...


class Recorded:
    """A policy that repeats recorded actions."""

    def __init__(self, actions: list[dict]):
        self.rest = iter(actions)

    def act(self, history: list[dict]) -> dict:
        return next(self.rest, {"name": "stop"})


def retryable(status: int | None) -> bool:
    """No answer, too many requests, or a fault of the server."""
    return status is None or status == 429 or status >= 500


def with_retries(call: Callable[[], T], status_of: Callable[[Exception], int | None], attempts: int = 4, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """Calls again after pauses that double, as long as the error is retryable."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:
            if n == attempts or not retryable(status_of(e)):
                raise
            sleep(pause * 2 ** (n - 1))
    raise AssertionError("unreachable")


def cursor_pages(fetch: Callable[[str], tuple[list[dict], str | None]], most: int) -> Iterator[dict]:
    """Rows of a paged service until a page is empty, its cursor is absent or repeats, or `most` rows have come."""
    cursor, n = "*", 0
    while n < most:
        rows, following = fetch(cursor)
        for row in rows[: most - n]:
            n += 1
            yield row
        if not rows or not following or following == cursor:
            return
        cursor = following


def batches(ids: list[str], size: int = 200) -> Iterator[list[str]]:
    for i in range(0, len(ids), size):
        yield ids[i : i + size]


def without_lone_surrogates(value):
    """Strings, lists and dictionaries as they came from outside, with `?` for what UTF-8 cannot hold: Spark's strings are UTF-8."""
    if isinstance(value, str):
        return "".join("?" if 0xD800 <= ord(c) <= 0xDFFF else c for c in value)
    if isinstance(value, dict):
        return {without_lone_surrogates(k): without_lone_surrogates(v) for k, v in value.items()}
    if isinstance(value, list):
        return [without_lone_surrogates(v) for v in value]
    return value


def any_of(terms: list[str]) -> str:
    return " OR ".join(f'"{t}"' for t in terms)


#: What two services ask for open-access articles of a year.
YEAR_QUERIES = {"pmc": "{year}[PDAT] AND open access[filter]", "europe_pmc": "PUB_YEAR:{year} AND OPEN_ACCESS:Y AND HAS_PDF:Y"}


def article_query(service: str, year: int, query: str | None = None) -> str:
    """A service's expression for open-access articles of a year, that also fit a query if there is one."""
    wanted = YEAR_QUERIES[service].format(year=year)
    return f"({query}) AND {wanted}" if query else wanted


def identified(tool: str, email: str | None = None, api_key: str | None = None) -> dict[str, str]:
    """Parameters that tell a service who asks; what is empty is left out."""
    return {k: v for k, v in (("tool", tool), ("email", email), ("api_key", api_key)) if v}


class ContextProvider(Protocol):
    """Gives a trajectory more context, or an empty string."""

    def context(self, query: str, title: str) -> str: ...


class StaticContext:
    """The same context, known beforehand, for every request."""

    def __init__(self, text: str | None = None):
        self.text = (text or "").strip()

    def context(self, query: str, title: str) -> str:
        return self.text


class LinesContext:
    """Context typed by someone: lines up to a blank one; `skip` as the first line gives none."""

    def __init__(self, read: Callable[[], str | None]):
        self.read = read

    def context(self, query: str, title: str) -> str:
        given: list[str] = []
        while (line := self.read()) is not None and line.strip():
            if not given and line.strip().lower() == "skip":
                return ""
            given.append(line)
        return "\n".join(given).strip()


def progress_line(at: int, total: int, title: str, kept: int, every: int | None) -> str | None:
    """A line for the first and each `every`-th paper; none without a step."""
    if not every or every < 0 or (at != 1 and at % every):
        return None
    return f"[{at}/{total}] Example source paper: {title} | kept {kept} dataset row(s) so far"

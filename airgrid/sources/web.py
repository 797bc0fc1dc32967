"""Requests to services that allow only so many a second: one task sends them one after the other.

The rate belongs to the service and not to a task, so the requests of a run share one task on purpose;
what they answer is small and goes on as a table.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

RESULTS = "array<struct<id:bigint,poster_path:string,vote_average:double,overview:string,original_language:string,first_air_date:string,release_date:string>>"
SEARCH_GAP, PROBE_GAP, TIMEOUT = 0.25, 0.2, 10
_FIELDS = {"id": int, "poster_path": str, "vote_average": float, "overview": str, "original_language": str, "first_air_date": str, "release_date": str}


def paced(df: DataFrame, ask: Callable[[dict], dict], gap: float, schema: str) -> DataFrame:
    """``ask`` of each row, with at least ``gap`` seconds between the beginnings of two requests."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = float("-inf")
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                time.sleep(max(0.0, gap - (time.monotonic() - last)))
                last = time.monotonic()
                out.append(ask(row))
            yield pd.DataFrame(out, columns=names)

    return df.repartition(1).mapInPandas(run, schema)


def _result(told: dict) -> dict:
    """A search result with known fields; a field of another type fails the answer."""
    out = {}
    for name, kind in _FIELDS.items():
        value = told.get(name)
        if value is not None and not isinstance(value, (int, float) if kind is float else kind):
            raise TypeError(f"{name} is a {type(value).__name__}")
        out[name] = kind(value) if value is not None else None
    return out


def search(keys: DataFrame, url: str, token: str, gap: float = SEARCH_GAP) -> DataFrame:
    """``key, movie, results`` for each search (lookup_title, movie, key); an error or another status gives no results."""

    def ask(row: dict) -> dict:
        where = "movie" if row["movie"] else "tv"
        request = urllib.request.Request(f"{url.rstrip('/')}/3/search/{where}?query={urllib.parse.quote_plus(row['lookup_title'])}", headers={"Authorization": f"Bearer {token}", "Accept": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
                found = [_result(r) for r in (json.load(answer).get("results") or [])[:1]] if answer.status == 200 else []
        except (OSError, ValueError, TypeError, AttributeError):
            found = []
        return {"key": row["key"], "movie": row["movie"], "results": found}

    return paced(keys.select("lookup_title", "movie", "key"), ask, gap, f"key string, movie boolean, results {RESULTS}")


def probe(urls: DataFrame, gap: float = PROBE_GAP) -> DataFrame:
    """``url``: those of ``urls`` (url) that answer a HEAD request with status 200."""

    def ask(row: dict) -> dict:
        try:
            with urllib.request.urlopen(urllib.request.Request(row["url"], method="HEAD"), timeout=TIMEOUT) as answer:
                return {"url": row["url"], "there": answer.status == 200}
        except (OSError, ValueError):
            return {"url": row["url"], "there": False}

    return paced(urls.select("url").distinct(), ask, gap, "url string, there boolean").where("there").select("url")


def fetch_images(urls: DataFrame, gap: float = 0.0) -> DataFrame:
    """``url, content_type, body`` of the images that arrive."""

    def ask(row: dict) -> dict:
        try:
            with urllib.request.urlopen(row["url"], timeout=TIMEOUT) as answer:
                return {"url": row["url"], "content_type": answer.headers.get("Content-Type") or "application/octet-stream", "body": answer.read()}
        except (OSError, ValueError):
            return {"url": row["url"], "content_type": None, "body": None}

    return paced(urls.select("url").distinct(), ask, gap, "url string, content_type string, body binary").where("body is not null")

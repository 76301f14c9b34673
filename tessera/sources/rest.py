"""A Python data source over JSON REST requests: one partition a request, pages followed by a cursor.

Option `opener` names a function "module:function" (request dict, headers -> status, text), for tests
and for other HTTP clients. A failed request gives one row with `error` and no value, so that a partial
read shows; rows read before the failure stay.
"""

from __future__ import annotations

import importlib
import json
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ERROR_CHARS = 500


def open_url(request: dict, headers: dict) -> tuple[int, str]:
    url = request["url"] + ("?" + urllib.parse.urlencode(request["params"]) if request.get("params") else "")
    body = json.dumps(request["body"]).encode() if "body" in request else None
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers), timeout=float(request.get("timeout", 30))) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")
    except OSError as e:
        return 0, str(e)


class RestPartition(InputPartition):
    def __init__(self, request: dict):
        super().__init__(request)
        self.request = request


class RestReader(DataSourceReader):
    def __init__(self, requests: list[dict], headers: dict, opener: str | None):
        self.requests, self.headers, self.opener = requests, headers, opener

    def partitions(self) -> list[RestPartition]:
        return [RestPartition(r) for r in self.requests]

    def read(self, partition: RestPartition):
        yield from rows_of(partition.request, self.headers, self.opener)


def rows_of(request: dict, headers: dict, opener: str | None):
    """(parent, pos, JSON, error) for each item of the pages that a request gives."""
    ask, request, pos = asker(opener), dict(request), 0
    while True:
        status, text = ask(request, headers)
        if status != 200:
            yield (request.get("parent"), pos, None, f"{status}: {text[:ERROR_CHARS]}")
            return
        data = json.loads(text)
        where = request.get("list")
        items = data if where is None else [data] if where == "" else data.get(where, [])
        for item in items:
            yield (request.get("parent"), pos, json.dumps(item, ensure_ascii=False), None)
            pos += 1
        if request.get("token"):  # a page token instead of a cursor
            more, name = data.get("nextPageToken"), "nextPageToken"
        else:
            more, name = data.get("has_more") and data.get("next_cursor"), "start_cursor"
        if not (request.get("cursor") and more):
            return
        place = "body" if "body" in request else "params"
        request = request | {place: request.get(place, {}) | {name: more}}


def asker(opener: str | None):
    if not opener:
        return open_url
    module, name = opener.split(":")
    return getattr(importlib.import_module(module), name)


class RestSource(DataSource):
    """Base of the REST formats; columns parent, pos, value (JSON), error."""

    def schema(self) -> str:
        return "parent string, pos int, value string, error string"

    def requests(self, schema) -> list[dict]:
        raise NotImplementedError

    def headers(self) -> dict:
        return {}

    def reader(self, schema) -> RestReader:
        return RestReader(self.requests(schema), self.headers(), self.options.get("opener"))


def test_connection(request: dict, headers: dict, opener=open_url) -> tuple[bool, str]:
    status, text = opener(request, headers)
    return (True, "") if status == 200 else (False, f"{status}: {text[:ERROR_CHARS]}")


test_connection.__test__ = False

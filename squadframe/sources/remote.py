"""Python data sources: JSON answers of a server behind a cache of files, and tables of SQLite files.

Both are read by Spark's tasks: the answers a few endpoints at a time, the tables by ranges of rowid. Cache and database
are paths that the executors share. Sent by value, so a cluster needs no copy of this package.
"""

from __future__ import annotations

import base64
import json
import os
import re
import sqlite3
import sys
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Endpoints that one task asks for, one after the other.
ENDPOINTS_IN_PART = 50


class Part(InputPartition):
    def __init__(self, *values):
        self.values = values


def cache_name(key: str) -> str:
    """File name of a cached answer."""
    return base64.urlsafe_b64encode(key.encode()).decode().rstrip("=") + ".json"


class Answers(DataSource):
    """`answers`: (endpoint, status, cached, payload) of the endpoints of a server, the payload as JSON text.

    Options: base_url, endpoints (a JSON array of texts), cache (a folder; none: nothing is kept), header_<name>,
    delay_ms between requests of a task, retry_ms before the one retry after status 429 (unless the answer says
    retry-after), fail (true: any other status than 2xx fails the read, as by default; false: it is a row without payload).
    What is no JSON becomes {"raw": text}. Only good answers are kept, each under its endpoint's name and written aside
    first, so that a task which runs twice or fails half-way leaves no half of a file.
    """

    @classmethod
    def name(cls) -> str:
        return "answers"

    def schema(self) -> str:
        return "endpoint string, status int, cached boolean, payload string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return AnswersReader(dict(self.options))


class AnswersReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.base, self.endpoints, self.cache = options["base_url"].rstrip("/"), json.loads(options["endpoints"]), options.get("cache")
        self.headers = {k.removeprefix("header_"): v for k, v in options.items() if k.startswith("header_")}
        self.delay, self.wait = int(options.get("delay_ms", 0)) / 1000, int(options.get("retry_ms", 1000)) / 1000
        self.fail, self.in_part = options.get("fail", "true").lower() == "true", int(options.get("endpoints_in_part", ENDPOINTS_IN_PART))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Endpoints that are not asked for are not fetched."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("endpoint",):
                self.endpoints = [e for e in self.endpoints if e == f.value]
            elif isinstance(f, In) and f.attribute == ("endpoint",):
                self.endpoints = [e for e in self.endpoints if e in set(f.value)]
            else:
                yield f

    def partitions(self) -> list[Part]:
        return [Part(self.endpoints[at : at + self.in_part]) for at in range(0, len(self.endpoints), self.in_part)]

    def read(self, part: Part) -> Iterator[tuple]:
        for endpoint in part.values[0] if part else ():
            at = os.path.join(self.cache, cache_name(endpoint)) if self.cache else None
            if at and (kept := self._kept(at)) is not None:
                yield endpoint, 200, True, kept
                continue
            status, text = self._get(endpoint)
            good = 200 <= status < 300
            if not good and self.fail:
                raise RuntimeError(f"{status}: {endpoint} {text[:200]}")
            try:
                payload = json.dumps(json.loads(text), ensure_ascii=False) if text else "{}"
            except ValueError:
                payload = json.dumps({"raw": text}, ensure_ascii=False)
            if good and at:
                os.makedirs(self.cache, exist_ok=True)
                aside = f"{at}.{uuid.uuid4().hex}"
                with open(aside, "w", encoding="utf-8") as f:
                    f.write(payload)
                os.replace(aside, at)
            yield endpoint, status, False, payload if good else None
            time.sleep(self.delay)

    def _kept(self, at: str) -> str | None:
        try:
            with open(at, encoding="utf-8") as f:
                text = f.read()
            json.loads(text)
            return text
        except (OSError, ValueError):  # not there, or no answer
            return None

    def _get(self, endpoint: str, again: bool = True) -> tuple[int, str]:
        try:
            with urllib.request.urlopen(urllib.request.Request(self.base + endpoint, headers=self.headers), timeout=60) as answer:
                return answer.status, answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code == 429 and again:
                said = e.headers.get("retry-after") or ""
                time.sleep(float(said) if re.fullmatch(r"\d+(\.\d+)?", said) and float(said) > 0 else self.wait)
                return self._get(endpoint, again=False)
            return e.code, e.read().decode("utf-8", "replace")


class SqliteTable(DataSource):
    """`sqlite`: a table of a SQLite file. Options: path, table, parts (ranges of rowid, 8 by default).

    Columns are those that the file declares: integers, reals, texts and blobs. Comparisons, lists and null checks are
    answered by SQLite where they are on a column of the table.
    """

    _KINDS = (("INT", "long"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BLOB", "binary"))

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute(f"pragma table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        kind = lambda declared: next((k for word, k in self._KINDS if word in declared.upper()), "string")
        return ", ".join(f"`{c[1]}` {kind(c[2])}" for c in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options), schema)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("parts", 8))
        self.columns, self.kinds, self.where, self.values = schema.names, [f.dataType.typeName() for f in schema], [], []

    def _db(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            known = len(f.attribute) == 1 and f.attribute[0] in self.columns if hasattr(f, "attribute") else False
            if known and type(f) in signs and isinstance(f.value, int | float | str) and not isinstance(f.value, bool):
                self.where.append(f"{_quoted(f.attribute[0])} {signs[type(f)]} ?")
                self.values.append(f.value)
            elif known and isinstance(f, In) and all(isinstance(v, int | float | str) for v in f.value):
                self.where.append(f"{_quoted(f.attribute[0])} in ({', '.join('?' * len(f.value))})")
                self.values.extend(f.value)
            elif known and isinstance(f, IsNotNull):
                self.where.append(f"{_quoted(f.attribute[0])} is not null")
            else:
                yield f

    def partitions(self) -> list[Part]:
        with self._db() as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
        if low is None:
            return [Part(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [Part(at, min(high + 1, at + step)) for at in range(low, high + 1, step)]

    def read(self, part: Part) -> Iterator[tuple]:
        to = {"long": int, "double": float, "string": str, "binary": bytes}
        where = " and ".join(["rowid >= ? and rowid < ?", *self.where])
        columns = ", ".join(map(_quoted, self.columns))
        with self._db() as db:
            for row in db.execute(f"select {columns} from {_quoted(self.table)} where {where}", [*part.values, *self.values]):
                yield tuple(None if v is None else to[k](v) if k != "binary" or not isinstance(v, str) else v.encode() for v, k in zip(row, self.kinds, strict=True))


def use_sources(spark: SparkSession) -> None:
    """Makes the formats `answers` and `sqlite` known to the session and lets their filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Answers)
    spark.dataSource.register(SqliteTable)


def answers(spark: SparkSession, base_url: str, endpoints: list[str], cache: str | None = None, **options: object) -> DataFrame:
    """The answers of some endpoints, read through the cache."""
    use_sources(spark)
    said = {"base_url": base_url, "endpoints": json.dumps(endpoints), **({"cache": cache} if cache else {}), **{k: str(v) for k, v in options.items()}}
    return spark.read.format("answers").options(**said).load()


def sqlite_table(spark: SparkSession, path: str, name: str, parts: int = 8) -> DataFrame:
    """A table of a SQLite file, read in as many ranges of rowid."""
    use_sources(spark)
    return spark.read.format("sqlite").options(path=path, table=name, parts=str(parts)).load()

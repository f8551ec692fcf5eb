"""Answers of a server on this machine behind a cache, and a small SQLite file."""

import http.server
import json
import sqlite3
import threading
from collections import Counter

import pytest

from squadframe.sources import remote


@pytest.fixture
def server():
    asked = Counter()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            busy = self.path == "/busy" and asked[self.path] == 1 or self.path == "/always"
            status = 429 if busy else 500 if self.path == "/broken" else 403 if self.headers.get("x-api-key") != "k" else 200
            body = "" if self.path == "/empty" else "plain text" if self.path == "/text" else json.dumps({"path": self.path, "é": [1, 2]})
            self.send_response(status)
            if busy and self.path == "/busy":
                self.send_header("retry-after", "0.2")
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    http_server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http_server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http_server.server_port}", asked
    http_server.shutdown()


def test_answers_are_read_through_the_cache(spark, tmp_path, server):
    url, asked = server
    cache = tmp_path / "cache"
    ends = ["/a?x=1", "/b", "/text", "/empty", "/busy"]
    read = lambda: remote.answers(spark, url, ends, str(cache), header_x_api_key="k", **{"header_x-api-key": "k"}, endpoints_in_part=2, retry_ms=50)
    got = {r.endpoint: r for r in read().collect()}
    assert {e: (r.status, r.cached) for e, r in got.items()} == dict.fromkeys(ends, (200, False))
    assert json.loads(got["/a?x=1"].payload) == {"path": "/a?x=1", "é": [1, 2]} and json.loads(got["/text"].payload) == {"raw": "plain text"} and got["/empty"].payload == "{}"
    assert asked == {"/a?x=1": 1, "/b": 1, "/text": 1, "/empty": 1, "/busy": 2}
    assert sorted(p.name for p in cache.iterdir()) == sorted(remote.cache_name(e) for e in ends)
    before = dict(asked)
    again = {r.endpoint: r for r in read().collect()}
    assert all(r.cached for r in again.values()) and {e: r.payload for e, r in again.items()} == {e: r.payload for e, r in got.items()} and asked == before
    (cache / remote.cache_name("/b")).write_text("{half")  # what is no JSON is asked for again
    assert {r.endpoint: r.cached for r in read().collect()} == {e: e != "/b" for e in ends}


def test_answers_that_fail(spark, tmp_path, server):
    url, asked = server
    ends = ["/always", "/broken", "/fine"]
    got = {r.endpoint: (r.status, r.payload is None) for r in remote.answers(spark, url, ends, str(tmp_path / "c"), fail=False, retry_ms=10, **{"header_x-api-key": "k"}).collect()}
    assert got == {"/always": (429, True), "/broken": (500, True), "/fine": (200, False)} and asked["/always"] == 2  # one retry
    assert [p.name for p in (tmp_path / "c").iterdir()] == [remote.cache_name("/fine")]
    with pytest.raises(Exception, match="403"):
        remote.answers(spark, url, ["/x"]).collect()
    assert remote.answers(spark, url, []).count() == 0


def test_endpoints_that_no_one_asks_for_are_not_fetched(spark, server):
    url, asked = server
    rows = remote.answers(spark, url, [f"/{i}" for i in range(20)], **{"header_x-api-key": "k"})
    assert [r.endpoint for r in rows.where("endpoint = '/7'").collect()] == ["/7"]
    assert sorted(r.endpoint for r in rows.where("endpoint in ('/3', '/5', '/none')").collect()) == ["/3", "/5"]
    assert set(asked) == {"/7", "/3", "/5"}


def test_sqlite_tables(spark, tmp_path):
    at = str(tmp_path / "x.db")
    rows = [(i * 3, i, None if i % 7 == 0 else f"p{i}", i / 4, bytes([i % 256])) for i in range(1, 400)]
    with sqlite3.connect(at) as db:
        db.execute('create table games (game_id integer primary key, fetched_at integer not null, payload text, "odd name" real, b blob)')
        db.executemany("insert into games values (?, ?, ?, ?, ?)", rows)
        db.execute("create table none (x text)")
    games = remote.sqlite_table(spark, at, "games", 5)
    assert games.schema.simpleString() == "struct<game_id:bigint,fetched_at:bigint,payload:string,odd name:double,b:binary>"
    assert sorted((*r[:4], bytes(r[4])) for r in games.collect()) == rows and games.rdd.getNumPartitions() == 5
    some = games.where("game_id > 300 and fetched_at <= 150 and payload is not null and `odd name` in (30.0, 30.25, 31.5, 99.0)")
    assert sorted(r.game_id for r in some.collect()) == sorted(g for g, f, p, o, _ in rows if g > 300 and f <= 150 and p and o in (30.0, 30.25, 31.5, 99.0))
    assert games.where("payload like 'p1%'").count() == sum(str(p).startswith("p1") for _, _, p, _, _ in rows)
    assert remote.sqlite_table(spark, at, "none").count() == 0
    with pytest.raises(Exception, match="no table"):
        remote.sqlite_table(spark, at, "missing").count()

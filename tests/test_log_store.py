"""The log store's source against a server of this test."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from granary.sources import log_store

#: 40 lines of one time, one line a second otherwise.
LINES = sorted([(10**9 * i, {"job": "app", "level": "WARN" if i % 3 else "INFO", "service": f"s{i % 2}"}, f"line {i}") for i in range(200)] + [(50 * 10**9, {"job": "app"}, f"at once {i}") for i in range(40)] + [(7, {"job": "other"}, "elsewhere")], key=lambda x: (x[0], json.dumps(x[1], sort_keys=True), x[2]))
ASKED: list[dict] = []


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        ASKED.append(q)
        want = dict(p.split("=", 1) for p in q["query"].strip("{}").split(", ") if p)
        own = [x for x in LINES if int(q["start"]) <= x[0] < int(q["end"]) and all(x[1].get(k) == json.loads(v) for k, v in want.items())][: int(q["limit"])]
        body = json.dumps({"status": "success", "data": {"result": [{"stream": s, "values": [[str(t), line]]} for t, s, line in own]}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def app(lines=None):
    return sorted(x[2] for x in (lines or LINES) if x[1]["job"] == "app")


@pytest.mark.parametrize("page", [7, 40, 41, 1000])
def test_pages_lose_and_repeat_nothing(url, page):
    got = list(log_store.lines(url, '{job="app"}', 0, 10**12, page))
    assert sorted(x[2] for x in got) == app() and [x[0] for x in got] == sorted(x[0] for x in got)


def test_an_unwell_store_is_an_error():
    with pytest.raises(RuntimeError, match="says error"):
        list(log_store.lines("", "{}", 0, 1, get=lambda _: '{"status": "error"}'))


def source(reader, url, **options):
    return reader.format("log_store").options(url=url, topic="app", start=0, page=16, **options)


def test_batches_push_their_filters(spark, url):
    rows = log_store.log_lines(spark, url, "app", 0, 10**12, page=16)
    assert sorted(r.message for r in rows.collect()) == app()
    first = rows.where("message = 'at once 3'").first()
    assert (first.at, first.level, first.source, first.service_name, first.labels) == (50 * 10**9, "INFO", "unknown", "unknown", {"job": "app"})
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        ASKED.clear()
        few = log_store.log_lines(spark, url, "app", 0, 10**12, page=16).where((F.col("at") >= 20 * 10**9) & (F.col("at") < 30 * 10**9) & (F.col("level") == "WARN"))
        assert sorted(r.message for r in few.collect()) == app([x for x in LINES if 20 * 10**9 <= x[0] < 30 * 10**9 and x[1].get("level") == "WARN"])
        assert ASKED and all('level="WARN"' in q["query"] and int(q["start"]) >= 20 * 10**9 and int(q["end"]) <= 30 * 10**9 for q in ASKED)
        # a default stands for a missing label, which the store cannot be asked for
        assert sorted(r.message for r in log_store.log_lines(spark, url, "app", 0, 10**12, page=16).where("level = 'INFO'").collect()) == app([x for x in LINES if x[1].get("level", "INFO") == "INFO"])
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_stream_goes_on_where_it_was(spark, url, tmp_path):
    spark.dataSource.register(log_store.LogStore)
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"

    def run(end):
        q = source(spark.readStream, url, end=end, step=30 * 10**9).load().writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start(out)
        import time

        until = time.time() + 40
        while time.time() < until and not (q.lastProgress and str(end) in str(q.lastProgress["sources"][0]["endOffset"])):
            assert q.exception() is None
            time.sleep(0.2)
        q.stop()

    run(60 * 10**9)
    assert sorted(r.message for r in spark.read.parquet(out).collect()) == app([x for x in LINES if x[0] < 60 * 10**9])
    run(10**12 // 5)
    assert sorted(r.message for r in spark.read.parquet(out).collect()) == app([x for x in LINES if x[0] < 10**12 // 5])

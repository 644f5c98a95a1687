"""The paged register against a small server that can fail."""

import json
import threading
import urllib.parse
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from larkspur.sources import paged


class Server:
    def __init__(self, n, failing=(), code=503, least=0):
        self.asked, self.posted = Counter(), []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def said(self, text):
                args = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query)) | dict(urllib.parse.parse_qsl(text))
                limit, offset = max(int(args["limit"]), least), int(args["offset"])
                outer.asked[offset] += 1
                if offset in failing and (code < 500 or outer.asked[offset] <= failing[offset]):
                    self.send_error(code)
                    return
                rows = [{"uid": {"type": "literal", "value": str(k)}, "name": {"type": "literal", "value": f"Firma {k}"}} | ({"worth": {"value": f"{k}.5"}} if k % 2 else {}) for k in range(offset, min(offset + limit, n))]
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps({"results": {"bindings": rows}}).encode())

            def do_GET(self):
                self.said("")

            def do_POST(self):
                text = self.rfile.read(int(self.headers["Content-Length"])).decode()
                outer.posted.append(text)
                self.said(urllib.parse.parse_qs(text)["query"][0])

            def log_message(self, *args):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}/sparql?limit={{limit}}&offset={{offset}}"

    def __enter__(self):
        return self

    def __exit__(self, *args):
        self.http.shutdown()


def read(spark, url, **options):
    paged.register(spark)
    said = {"url": url, "columns": "uid long, name string, worth double", "size": 10, "tasks": 3, "wait": 0} | options
    return spark.read.format("paged_register").options(**{k: str(v) for k, v in said.items()}).load()


@pytest.mark.parametrize("n", [1, 9, 10, 11, 30, 47])
def test_all_pages_once(spark, n):
    with Server(n) as server:
        found = sorted(tuple(r) for r in read(spark, server.url).collect())
        assert found == [(k, f"Firma {k}", k + 0.5 if k % 2 else None) for k in range(n)]
        assert set(server.asked.values()) == {1} and len(server.asked) <= n // 10 + 3


def test_a_page_is_tried_again_by_itself(spark):
    with Server(35, failing={0: 1, 20: 2}) as server:
        assert read(spark, server.url).count() == 35
        assert server.asked[0] == 2 and server.asked[20] == 3 and server.asked[10] == server.asked[30] == 1
    with Server(35, failing={20: 99}) as server, pytest.raises(Exception, match="page 2 failed after 2 attempts"):
        read(spark, server.url, attempts=2).count()


def test_refusals_are_not_tried_again(spark):
    with Server(35, failing={10: 1}, code=404) as server:
        with pytest.raises(Exception, match="page 1: the register answered 404"):
            read(spark, server.url, tasks=2).count()
        assert server.asked[10] == 1
    with Server(35, failing={10: 1}, code=429) as server, pytest.raises(Exception, match="failed after 3 attempts"):
        read(spark, server.url, tasks=2).count()


def test_no_rows_and_too_many_are_errors(spark):
    with Server(0) as server, pytest.raises(Exception, match="gave no rows"):
        read(spark, server.url).count()
    with Server(50, least=25) as server, pytest.raises(Exception, match="25 rows, 10 were asked for"):
        read(spark, server.url).count()
    with Server(5) as server, pytest.raises(Exception, match="ValueError"):
        read(spark, server.url, columns="uid long, name long").count()


def test_queries_are_posted_and_options_checked(spark):
    with Server(12) as server:
        base = server.url.partition("?")[0]
        assert read(spark, base, query="limit={limit}&offset={offset}&x=ü").count() == 12 and len(server.posted) == 4
    with pytest.raises(Exception, match="either url or answers"):
        read(spark, "x", answers="y").count()
    with pytest.raises(Exception, match="1 at least"):
        read(spark, "x", size=0).count()


def test_recorded_answers(spark, tmp_path):
    for k, n in enumerate((2, 2, 1)):
        (tmp_path / f"page={k}").mkdir()
        (tmp_path / f"page={k}" / "part-0.txt").write_text(json.dumps({"results": {"bindings": [{"uid": {"value": str(2 * k + i)}} for i in range(n)]}}))
    paged.register(spark)
    found = spark.read.format("paged_register").schema("uid int, street string").option("answers", f"file://{tmp_path}").option("size", 2).load()
    assert sorted(tuple(r) for r in found.collect()) == [(k, None) for k in range(5)]

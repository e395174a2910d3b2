import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from heronry.operators import sequences
from heronry.sources import corpus, feeds
from heronry.streaming.loops import run_available


@pytest.fixture(scope="module")
def server():
    notes = [{"id": f"note#{i}", "number": i, "content": {"title": f"t{i}"}} for i in range(1, 9)]

    class Handler(BaseHTTPRequestHandler):
        shown = 4

        def do_GET(self):
            q = parse_qs(urlsplit(self.path).query)
            if self.path.startswith("/notes"):
                after = int(q["after"][0].split("#")[1]) if "after" in q else 0
                body = json.dumps({"notes": [n for n in notes[: Handler.shown] if n["number"] > after][: int(q["limit"][0])]})
                self.send_response(200)
            else:
                body = f"<p>{self.path}</p>"
                self.send_response(404 if "missing" in self.path else 200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", Handler
    s.shutdown()


def test_note_feed(spark, server, tmp_path):
    url, handler = server
    feeds.register_note_feed(spark)
    table = str(tmp_path / "t")

    def once():
        stream = spark.readStream.format("notes").option("url", url).option("pageSize", 3).load()
        query = run_available(stream, lambda batch, _: corpus.write_once(batch, table, ["id"]), str(tmp_path / "c"), period="0 seconds")
        query.processAllAvailable()
        query.stop()
        return sorted(r.number for r in spark.read.parquet(table).collect())

    assert once() == [1, 2, 3, 4]
    handler.shown = 8
    assert once() == list(range(1, 9))
    assert spark.read.format("notes").option("url", url).option("pageSize", 3).load().count() == 8


def test_fetch(spark, server):
    url, _ = server
    urls = spark.createDataFrame([(f"{url}/a",), (f"{url}/missing",), ("http://127.0.0.1:1/x",), (None,)], "url string")
    got = {r.url: r for r in feeds.fetch(urls).collect()}
    assert got[f"{url}/a"].body == "<p>/a</p>" and got[f"{url}/missing"].status == "404"
    assert got["http://127.0.0.1:1/x"].control.code == "halt" and len(got) == 3


def test_rewritings():
    tried = []

    def get(u):
        tried.append(u)
        if "api/query" in u:
            return u, "200", "ok"
        raise OSError("blocked")

    assert feeds.fetch_one("https://arxiv.org/abs/1234.5", get)[2] == "ok" and tried[1].endswith("id_list=1234.5")
    assert feeds.fetch_one("https://doi.org/10.48550/arXiv.99", get)[2] == "ok"
    assert feeds.fetch_one("https://x.org", get)[3] == ("halt", "blocked")


def test_pages_of_a_feed(spark):
    notes = spark.range(1, 10).withColumnRenamed("id", "number")
    assert [(r.number, r.page) for r in sequences.fetch_pages(notes, "number", 3, 4).collect()] == [(1, 0), (2, 0), (3, 0), (4, 1)]


def test_cli_parses():
    from heronry.cli import _parser

    assert _parser().parse_args(["summary", "--table", "x"]).command == "summary"
    with pytest.raises(SystemExit):
        _parser().parse_args(["nothing"])

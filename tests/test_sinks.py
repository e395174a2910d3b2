"""The partitioned feed, the committing sinks, and timers of keyed state, each over a failure or a restart."""

import http.server
import json
import threading
import urllib.parse
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from heronry.sources import entries, feeds
from heronry.streaming import loops


class Server(http.server.BaseHTTPRequestHandler):
    notes, asked, posted, refuse = 4000, [], [], set()

    def _send(self, code, body):
        data = json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        q = {k: int(v[0]) for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items() if k in ("offset", "limit")}
        self.asked.append(q["limit"])
        rows = range(q["offset"], min(type(self).notes, q["offset"] + q["limit"]))
        self._send(200, {"notes": [{"id": f"note#{k}", "number": 2 * k, "content": {"k": k}} for k in rows], "count": type(self).notes})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if body["id"] in self.refuse:
            self._send(500, {})
        else:
            self.posted.append(body["id"])
            self._send(200, {})

    def log_message(self, *args):
        pass


@pytest.fixture
def service():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Server.notes, Server.asked[:], Server.posted[:], Server.refuse = 4000, [], [], set()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_feed_in_ranges(spark, service, tmp_path):
    feeds.register_note_feed(spark)
    source = {"url": service, "pageSize": "50", "pagesPerTask": "8", "maxPerBatch": "1000", "progress": str(tmp_path / "progress")}
    d = spark.read.format("note_ranges").options(**source).load()
    assert d.rdd.getNumPartitions() == 10 and d.agg(F.count("*"), F.countDistinct("id"), F.max("number")).first() == (4000, 4000, 7998)
    assert max(Server.asked) == 50
    table, marks, sizes = str(tmp_path / "t"), str(tmp_path / "m"), []

    def run():
        def each(batch, number):
            batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
            sizes.append(spark.read.parquet(f"{table}/batch={number}").count())

        return spark.readStream.format("note_ranges").options(**source).load().writeStream.foreachBatch(each).option("checkpointLocation", marks).trigger(processingTime="0 seconds").start()

    for total in (4000, 4700):
        Server.notes = total
        q = run()
        for _ in range(2400):
            if sum(sizes) >= total:
                break
            q.awaitTermination(0.1)
        q.stop()
        rows = spark.read.parquet(table)
        assert rows.count() == rows.select("id").distinct().count() == total
    assert sizes == [1000] * 4 + [700]


def test_entries_are_committed_by_task(spark, tmp_path):
    entries.register_entries(spark)
    root = str(tmp_path)
    rows = spark.range(40).select(F.concat(F.lit("e/"), (F.col("id") % 7).cast("string")).alias("entry"), F.lit(".").alias("subdir"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("content"))
    files = lambda: sorted(p.name for p in Path(root).rglob("f*") if not {"_drafts", "_reports"} & {*p.parts})
    bad = rows.withColumn("subdir", F.when(F.col("name") == "f39", "nowhere").otherwise(F.col("subdir"))).coalesce(1)
    with pytest.raises(Exception, match="no artefact folder"):
        bad.write.format("entries").option("root", root).mode("append").save()
    assert files() == [] and not list(Path(root).glob("_drafts/*"))
    for _ in range(2):
        rows.repartition(3).write.format("entries").option("root", root).mode("append").save()
    assert len(files()) == 40 and (Path(root) / "e/3/f3").read_text() == "t3"
    assert sorted(map(tuple, entries.reports(spark, root).collect())) == [(0, 40), (40, 0)]
    rows.limit(1).withColumn("content", F.lit("new")).write.format("entries").option("root", root).mode("overwrite").save()
    assert sum(p.read_text() == "new" for p in Path(root, "e").rglob("f*") if p.is_file()) == 1


def test_each_edit_is_posted_once(spark, service, tmp_path):
    feeds.register_note_feed(spark)
    src, marks, ledger = (str(tmp_path / x) for x in ("src", "marks", "ledger"))
    changed = spark.createDataFrame([(f"n{k}", "abstract", f"v{k}") for k in range(20)], "noteId string, fieldType string, value string")
    feeds.outbox(changed, "me").coalesce(2).write.parquet(src)
    ids = [json.loads(r.body)["id"] for r in spark.read.parquet(src).collect()]
    run = lambda: spark.readStream.schema("noteId string, fieldType string, body string").parquet(src).writeStream.format("outbox").option("url", service).option("ledger", ledger).option("checkpointLocation", marks).trigger(availableNow=True).start()
    Server.refuse = {ids[13]}
    with pytest.raises(Exception):  # noqa: B017
        run().awaitTermination()
    assert 0 < len(Server.posted) < 20
    Server.refuse = set()
    run().awaitTermination()
    assert Counter(Server.posted) == Counter(ids)
    run().awaitTermination()
    assert len(Server.posted) == 20


def test_abandoned_requests_time_out(spark, tmp_path):
    src, marks, out = (str(tmp_path / x) for x in ("events", "marks", "out"))
    schema = "request_id string, kind string, message string, ts timestamp"

    def arrive(rows):
        spark.createDataFrame(rows, "request_id string, kind string, message string, at long").select("request_id", "kind", "message", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src).withWatermark("ts", "0 seconds")
        q = loops.timed_request_cycles(stream, 60_000, "ts").writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.read.schema(loops.CYCLE_OUT).parquet(out).collect())), q

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        assert arrive([("a", "request", None, 100), ("b", "request", "blockedbyclient", 100), ("c", "request", None, 130)])[0] == []
        assert arrive([("a", "response", None, 131), ("a", "requestfinished", None, 132)])[0] == [("a", "success", False)]
        want = [("a", "success", False), ("b", "open", True)]
        got, q = arrive([("d", "request", None, 170)])  # b was last seen 70 seconds before
        assert got == want
        got, q = arrive([("c", "requestfailed", None, 180), ("e", "request", None, 400)])
        assert got == sorted([*want, ("c", "fail", False), ("d", "open", False)])
        got, q = arrive([("e", "requestfailed", None, 401)])
        assert got[-1] == ("e", "fail", False) and [s["numRowsTotal"] for s in json.loads(q.lastProgress.json)["stateOperators"]][-1:] == [0]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)

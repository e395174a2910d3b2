from pyspark.sql import functions as F

from heronry.streaming import loops


def test_fetch_loop_goes_on_where_it_ended(spark, tmp_path):
    feed, table, marks = (str(tmp_path / x) for x in ("feed", "table", "marks"))
    notes = spark.range(1, 9).select(F.concat(F.lit("note#"), F.col("id").cast("string")).alias("id"), F.col("id").alias("number")).coalesce(1)
    notes.filter("number <= 4").write.parquet(feed)
    loops.fetch_loop(spark, feed, "id string, number long", table, marks).awaitTermination()
    assert spark.read.parquet(table).count() == 4
    notes.write.mode("append").parquet(feed)  # the first four once more
    loops.fetch_loop(spark, feed, "id string, number long", table, marks).awaitTermination()
    assert sorted(r.number for r in spark.read.parquet(table).collect()) == list(range(1, 9))


def test_extraction_loop(spark, tmp_path):
    src, out = str(tmp_path / "pages"), str(tmp_path / "out")
    spark.range(5).write.parquet(src)
    loops.extraction_loop(spark, src, "id long", out, str(tmp_path / "m"), lambda d: d.filter("id % 2 = 0")).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_request_cycles(spark, tmp_path):
    src = str(tmp_path / "events")
    rows = [("a", "request", None), ("a", "response", None), ("a", "requestfinished", None), ("b", "request", None), ("b", "requestfailed", "net blockedbyclient"), ("c", "request", None)]
    spark.createDataFrame(rows, "request_id string, kind string, message string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("request_id string, kind string, message string").parquet(src)
    q = loops.request_cycles(stream).writeStream.format("memory").queryName("cycles").option("checkpointLocation", str(tmp_path / "m")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("cycles").collect())) == [("a", "success", False), ("b", "fail", True)]


def test_fetch_loop_moves_its_cursor(spark, tmp_path):
    feed, table, marks, cursors = (str(tmp_path / x) for x in ("feed", "table", "marks", "cursors"))
    notes = spark.range(1, 9).select(F.concat(F.lit("note#"), F.col("id").cast("string")).alias("id"), F.col("id").alias("number")).coalesce(1)
    log = loops.Log(spark, cursors, loops.CURSORS, ["role"])
    assert loops.last_fetched(log.now()).count() == 0
    for most in (4, 8):
        notes.filter(F.col("number").between(most - 3, most)).write.mode("append").parquet(feed)
        loops.fetch_loop(spark, feed, "id string, number long", table, marks, cursors=cursors).awaitTermination()
        assert [tuple(r) for r in loops.last_fetched(log.now()).collect()] == [(f"note#{most}", most)]


def test_extraction_runs_go_on_after_the_cursor(spark, tmp_path):
    body = '<meta name="citation_title" content="T"><meta name="citation_author" content="A"><meta name="citation_pdf_url" content="http://x.org/1.pdf"><meta name="description" content="%s">' % ("We study a thing. " * 15)
    notes = spark.createDataFrame([(f"n{i}", i, f"http://a.org/{i}", i != 2) for i in range(1, 7)], "id string, number long, url string, validUrl boolean")
    pages = spark.createDataFrame([(f"http://a.org/{i}", None, "404" if i == 4 else "200", body) for i in (1, 2, 4, 5, 6)], "url string, response_url string, status string, html string")
    root = str(tmp_path / "logs")
    logs = lambda name, schema, keys: loops.Log(spark, f"{root}/{name}", schema, keys).now()
    sent = [loops.extraction_run(spark, notes, pages, root, 2, batch, posted=True).count() for batch in (1, 2, 2, 3, 4)]
    assert sent[0] == 2 and sent[-1] == 0
    status = {r.id: (r.workflowStatus, r.httpStatus, r.hasAbstract) for r in logs("url_status", loops.URL_STATUS, ["id"]).collect()}
    assert status == {"n1": ("fields:posted", 200, True), "n3": ("extractor:fail", None, None), "n4": ("extractor:fail", 404, None), "n5": ("fields:posted", 200, True), "n6": ("fields:posted", 200, True)}
    assert [tuple(r) for r in logs("cursors", loops.CURSORS, ["role"]).collect()] == [("extract-fields", "n6", 6, "available")]
    assert logs("field_status", loops.FIELD_STATUS, ["noteId", "fieldType"]).count() == 6


def test_log_keeps_what_a_change_leaves_null(spark, tmp_path):
    log = loops.Log(spark, str(tmp_path / "log"), "id string, a int, b string", ["id"])
    for batch, rows in ((1, [("x", 1, "p"), ("y", 5, None)]), (2, [("x", None, "q")]), (2, [("x", None, "r")])):
        log.append(spark.createDataFrame(rows, "id string, a int, b string"), batch)
    assert sorted(map(tuple, log.now().collect())) == [("x", 1, "r"), ("y", 5, None)]

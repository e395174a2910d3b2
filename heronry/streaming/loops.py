"""The fetch and extraction loops as Structured Streaming queries, and a keyed state machine.

Progress lives in the checkpoint, so that a loop that is started again goes on where it ended.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, period: str | None = None) -> StreamingQuery:
    """Hands micro-batches to ``each``: what is there now, or, with a period, batch after batch at that pace."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=period) if period else writer.trigger(availableNow=True)).start()


class Log:
    """A keyed table as a log of changes: batches are appended, each under its own number, and ``now`` merges them.

    A batch that is run again replaces itself, so that nothing is counted twice; columns that a change leaves null keep their value.
    ``compact`` merges old batches into a base whose rows lie in buckets by their keys; ``of`` then reads a batch's own keys from their buckets alone, and the
    changes since, so that its cost follows the batch and not the table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets

    def append(self, changes: DataFrame, batch: int) -> None:
        kinds = dict(self.spark.createDataFrame([], self.schema).dtypes)
        columns = [(F.col(c) if c in changes.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
        if batch <= self.compacted():
            raise ValueError(f"batch {batch} is part of the base")
        changes.select(*columns).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def _fs(self, path: str) -> tuple:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _numbers(self, folder: str, name: str, done: str = "") -> list[int]:
        """The n of the folders ``name=n`` that are whole."""
        fs, target = self._fs(folder)
        if not fs.exists(target):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(target)]
        return sorted(int(n.partition("=")[2]) for n in found if n.startswith(f"{name}=") and (not done or fs.exists(self._fs(f"{folder}/{n}/{done}")[1])))

    def compacted(self) -> int:
        """The last batch that the base holds; -1 without a base."""
        return max(self._numbers(f"{self.path}/_base", "upto", "_SUCCESS"), default=-1)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def base(self, upto: int) -> DataFrame:
        """The base's rows, with their bucket, and its number as their batch."""
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/_base/upto={upto}").withColumn("batch", F.lit(upto).cast("long"))

    def rows(self) -> DataFrame:
        """All changes since the base with the number of their ``batch``."""
        there = [n for n in self._numbers(self.path, "batch") if n > self.compacted()]
        if not there:
            return self.spark.createDataFrame([], f"{self.schema}, batch long")
        return self.spark.read.schema(f"{self.schema}, batch long").option("basePath", self.path).parquet(*(f"{self.path}/batch={n}" for n in there))

    def _merged(self, keyed: DataFrame | None, before: int | None) -> DataFrame:
        upto = self.compacted()
        if before is not None and before <= upto:
            raise ValueError(f"batch {before} is part of the base")
        d = self.rows() if before is None else self.rows().where(F.col("batch") < before)
        old = self.base(upto) if upto >= 0 else None
        if keyed is not None:
            d = d.join(keyed, self.keys, "left_semi")
            if old is not None:
                held = [r[0] for r in keyed.select(self._bucket()).distinct().collect()]  # not more than buckets
                old = old.where(F.col("bucket").isin(held)).join(keyed, self.keys, "left_semi")
        d = d if old is None else d.unionByName(old.drop("bucket"))
        others = [c for c in d.columns if c not in (*self.keys, "batch")]
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch"))).alias(c)  # noqa: E731  a null order is never the greatest
        return d.groupBy(*self.keys).agg(*(last(c) for c in others)).select(*self.keys, *others)

    def now(self, before: int | None = None) -> DataFrame:
        """A row a key: of each column the last value that isn't null; with ``before``, as it was before that batch, which a run that is done again starts from."""
        return self._merged(None, before)

    def of(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """``now`` for the keys of a batch."""
        return self._merged(keys.select(*self.keys).distinct(), before)

    def compact(self, upto: int) -> None:
        """Merges the base and all batches up to ``upto`` into a new base; batches that may be run again must be later ones.

        The new base counts once it is whole, and what it holds is removed only then, so a compaction that is lost halfway is as if it hadn't begun.
        """
        was = self.compacted()
        if upto > was:
            new = self.now(upto + 1).withColumn("bucket", self._bucket())
            new.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/_base/upto={upto}")
        for old in [f"{self.path}/batch={n}" for n in self._numbers(self.path, "batch") if n <= upto] + [f"{self.path}/_base/upto={n}" for n in self._numbers(f"{self.path}/_base", "upto") if n < upto]:
            fs, target = self._fs(old)
            fs.delete(target, True)


class Locks:
    """Locks by name as files in a shared folder: a lock is taken by creating its file, which only one of several at once can."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.root}/{name}.lock"

    def take(self, name: str, owner: str) -> bool:
        """Whether ``owner`` has the lock now; an owner that has it already gets it again."""
        path = self._at(name)
        local = path if path.startswith("/") else path.removeprefix("file://") if path.startswith("file:///") else None
        if local is not None:
            os.makedirs(os.path.dirname(local), exist_ok=True)
            draft = f"{local}.{uuid.uuid4().hex}"
            with open(draft, "w") as f:
                f.write(owner)
            try:
                os.link(draft, local)  # fails if it is there, and shows the owner at once
                return True
            except FileExistsError:
                return self.owner(name) == owner
            finally:
                os.unlink(draft)
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            out = fs.create(target, False)
        except Py4JJavaError:
            if not fs.exists(target):
                raise
            return self.owner(name) == owner
        out.write(bytearray(owner.encode()))
        out.close()
        return True

    def owner(self, name: str) -> str | None:
        found = self.spark.read.option("wholetext", "true").text(self._at(name)).collect() if self._there(name) else []
        return found[0][0] if found else None

    def _there(self, name: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name))
        return bool(target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target))

    def release(self, name: str, owner: str) -> bool:
        """Gives the lock back; only its owner can."""
        if self.owner(name) != owner:
            return False
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name))
        return bool(target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, False))


CURSORS = "role string, noteId string, noteNumber long, lockStatus string"
URL_STATUS = "id string, requestUrl string, response string, responseHost string, httpStatus int, hasAbstract boolean, hasPdfLink boolean, workflowStatus string"
FIELD_STATUS = "noteId string, fieldType string, contentHash string"


def fetch_loop(spark: SparkSession, feed: str, schema: str, table: str, checkpoint: str, page_files: int = 1, cursors: str | None = None) -> StreamingQuery:
    """Notes that arrive as Parquet files in ``feed`` are saved once each; ``page_files`` of them a micro-batch.

    With ``cursors``, the log of the cursors, the ``fetch-notes`` cursor stands on the last note of each batch.
    """
    from heronry.sources.corpus import write_once

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", page_files).parquet(feed)

    def each(batch: DataFrame, number: int) -> None:
        write_once(batch, table, ["id"], number)
        if cursors:
            last = batch.groupBy(F.lit("fetch-notes").alias("role")).agg(F.max_by("id", "number").alias("noteId"), F.max("number").alias("noteNumber"))
            Log(batch.sparkSession, cursors, CURSORS, ["role"]).append(last, number)

    return run_available(stream, each, checkpoint)


def last_fetched(cursors: DataFrame) -> DataFrame:
    """The note that the fetch loop has come to: no row, or one."""
    return cursors.where("role = 'fetch-notes'").select("noteId", "noteNumber")


def extraction_step(notes: DataFrame, cursors: DataFrame, pages: DataFrame, fields: DataFrame, limit: int, posted: bool = False, role: str = "extract-fields") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cursor, url status, changed fields) after the next ``limit`` notes with a valid address, 0 for all that are left.

    ``notes`` (id, number, url, validUrl), ``pages`` (url, response_url, status, html), ``fields`` the stored (noteId, fieldType, contentHash).
    Pages with a ``noteId`` are answers to that note's own request; else they are found by address, and notes of one address share its page.
    A note has one page: of several, one of status 200 comes first.
    A note whose page is missing or not of status 200 ends in ``extractor:fail``, another in ``extractor:success``, or ``fields:posted`` if its
    fields are posted.  The cursor ends ``available`` on the last note, and is left where it was if there is none.
    """
    from heronry.functions.urls import host
    from heronry.operators.evidence import canonical_abstract, canonical_array, canonical_pdf_link, field_arrays
    from heronry.operators.extract import with_candidates
    from heronry.operators.state import changed_fields
    from heronry.plans.rules import GENERAL, RULES

    at = cursors.where(F.col("role") == role).agg(F.max("noteNumber")).scalar()  # one value
    todo = notes.where(F.col("validUrl") & (F.col("number") > F.coalesce(at, F.lit(-1))))
    todo = todo.orderBy("number").limit(limit) if limit > 0 else todo
    key = "noteId" if "noteId" in pages.columns else "url"
    page = F.struct((~F.col("status").eqNullSafe("200")).alias("failed"), F.coalesce("response_url", "url").alias("url"), "status", "html")
    answers = pages.groupBy(F.col(key).alias("_key")).agg(F.min(page).alias("_page"))
    wanted = todo.select(F.col("id").alias("page_id"), "number", F.col("url").alias("asked"), F.col("id" if key == "noteId" else "url").alias("_key"))
    fetched = wanted.join(answers, "_key", "left").select("page_id", "number", "asked", "_page.url", "_page.status", "_page.html")
    found = field_arrays(with_candidates(fetched.where("status = '200'").select("page_id", "url", "status", "html"), RULES), (*RULES, GENERAL))
    found = found.withColumn("best", F.transform(canonical_array(F.col("fields")), lambda f: F.struct(f["name"].alias("name"), f["value"].alias("value"))))
    found = found.select("page_id", canonical_abstract(F.col("best")).alias("abstract"), canonical_pdf_link(F.col("best")).alias("pdf"))
    judged = fetched.join(found, "page_id", "left").withColumn("ok", F.coalesce(F.col("status") == "200", F.lit(False)))
    state = F.when(~F.col("ok"), F.lit("extractor:fail")).otherwise(F.lit("fields:posted" if posted else "extractor:success"))
    has = lambda c: F.when(F.col("ok"), F.col(c).isNotNull())
    status = judged.select(F.col("page_id").alias("id"), F.col("asked").alias("requestUrl"), F.col("url").alias("response"), host(F.col("url")).alias("responseHost"), F.expr("try_cast(status as int)").alias("httpStatus"), has("abstract").alias("hasAbstract"), has("pdf").alias("hasPdfLink"), state.alias("workflowStatus"))
    values = judged.select(F.col("page_id").alias("noteId"), F.explode(F.array(*(F.struct(F.lit(k).alias("fieldType"), F.col(k).alias("value")) for k in ("abstract", "pdf")))).alias("f")).select("noteId", "f.*")
    last = todo.groupBy(F.lit(role).alias("role")).agg(F.max_by("id", "number").alias("noteId"), F.max("number").alias("noteNumber"))
    return last.withColumn("lockStatus", F.lit("available")), status, changed_fields(fields, values)


def extraction_run(spark: SparkSession, notes: DataFrame, pages: DataFrame, root: str, limit: int, batch: int, posted: bool = False) -> DataFrame:
    """One step over the logs below ``root`` (cursors, url_status, field_status); returns the fields to post.

    The fields are written first and the cursor last, so that a step that is lost halfway is done again, with the same result.
    """
    cursors, urls, fields = Log(spark, f"{root}/cursors", CURSORS, ["role"]), Log(spark, f"{root}/url_status", URL_STATUS, ["id"]), Log(spark, f"{root}/field_status", FIELD_STATUS, ["noteId", "fieldType"])
    cursor, status, changed = extraction_step(notes, cursors.now(batch), pages, fields.now(batch), limit, posted)
    out = f"{root}/changed/batch={batch}"
    changed.write.mode("overwrite").parquet(out)
    kept = spark.read.parquet(out)
    if posted:
        fields.append(kept, batch)
    urls.append(status, batch)
    cursors.append(cursor, batch)
    return kept


def extraction_loop(spark: SparkSession, pages: str, schema: str, out: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Extracts the pages that arrive; each micro-batch replaces its own partition, so that a repeat changes nothing."""
    stream = spark.readStream.schema(schema).parquet(pages)

    def each(batch: DataFrame, batch_id: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return run_available(stream, each, checkpoint)


CYCLE_OUT, CYCLE_STATE = "request_id string, outcome string, blocked boolean", "kinds string, blocked boolean"


def request_cycles(events: DataFrame) -> DataFrame:
    """(request_id, outcome, blocked) as soon as a request is finished or has failed; its state is dropped then.

    ``events`` has request_id, kind and message. The state is a few names a request in flight.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kinds, blocked = state.get if state.exists else ("", False)
        seen = set(filter(None, kinds.split(",")))
        for frame in frames:
            seen |= set(frame["kind"])
            blocked = bool(blocked or frame["message"].fillna("").str.contains("blockedbyclient").any())
        outcome = "success" if {"request", "response", "requestfinished"} <= seen else "fail" if {"request", "requestfailed"} <= seen else None
        if outcome:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"request_id": [key[0]], "outcome": [outcome], "blocked": [blocked]})
        else:
            state.update((",".join(sorted(seen)), blocked))

    return events.groupBy("request_id").applyInPandasWithState(step, CYCLE_OUT, CYCLE_STATE, "append", GroupStateTimeout.NoTimeout)


CYCLE_VALUE = "kinds string, blocked boolean, due long"


class _TimedCycles(StatefulProcessor):
    """A request's cycle with a timer: what isn't over ``timeout`` milliseconds after its last event is ``open``, and forgotten."""

    def __init__(self, timeout: int, ts: str | None):
        self.timeout, self.ts = timeout, ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("cycle", CYCLE_VALUE)

    def _over(self, key: tuple, outcome: str, blocked: bool) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"request_id": [key[0]], "outcome": [outcome], "blocked": [blocked]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # type: ignore[no-untyped-def]
        kinds, blocked, due = self.state.get() if self.state.exists() else ("", False, 0)
        seen, last = set(filter(None, kinds.split(","))), 0
        for frame in rows:
            seen |= set(frame["kind"])
            blocked = bool(blocked or frame["message"].fillna("").str.contains("blockedbyclient").any())
            last = max(last, int(frame[self.ts].max().timestamp() * 1000) if self.ts else timerValues.getCurrentProcessingTimeInMs())
        if due:
            self.handle.deleteTimer(due)
        outcome = "success" if {"request", "response", "requestfinished"} <= seen else "fail" if {"request", "requestfailed"} <= seen else None
        if outcome:
            yield from self._over(key, outcome, blocked)
        else:
            due = max(due, last + self.timeout)
            self.handle.registerTimer(due)
            self.state.update((",".join(sorted(seen)), blocked, due))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # type: ignore[no-untyped-def]
        if self.state.exists():
            _, blocked, due = self.state.get()
            if due <= expiredTimerInfo.getExpiryTimeInMs():
                yield from self._over(key, "open", blocked)

    def close(self) -> None:
        pass


def timed_request_cycles(events: DataFrame, timeout_ms: int, ts: str | None = None) -> DataFrame:
    """As ``request_cycles``, and a request that is neither finished nor failed ``timeout_ms`` after its last event gives ``open``; then no state is left of it.

    With ``ts``, a timestamp column, time is that of the events: give the stream a watermark on it.  Without, it is the clock's.  Timers and state are in the
    checkpoint, so they go on after a restart.  The session's state store becomes RocksDB, which timers need.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    columns = ["request_id", "kind", "message", *([ts] if ts else [])]
    return events.select(*columns).groupBy("request_id").transformWithStateInPandas(_TimedCycles(timeout_ms, ts), CYCLE_OUT, "append", "EventTime" if ts else "ProcessingTime")


def daily_counts(stream: DataFrame, ts: str, key: str, late: str = "2 days") -> DataFrame:
    """(day, key, n) of a stream, with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), key, "n")

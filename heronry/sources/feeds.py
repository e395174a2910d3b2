"""Network sources and sinks: a feed of notes as a streaming data source, a page fetcher, an outbox.

The note feed answers ``GET <url>/notes?sort=number:asc&after=<id>&limit=<n>`` with ``{"notes": [...]}``; its offset is the id
of the last note read, so a query that is started again goes on after it.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage

from heronry.functions.urls import ENTRY_QUERY

SCHEMA = "id string, number long, content string"
FETCHED = (
    "url string, response_url string, status string, body string, control struct<code:string,msg:string>, headers map<string,string>, "
    "request_headers map<string,string>, frames array<string>, chain array<string>, fetched_at timestamp"
)
#: Seconds: a page's navigation, and a call of the note service.
PAGE_TIMEOUT, CALL_TIMEOUT = 10, 60


def note_page(url: str, after: str | None, limit: int) -> list[tuple[str, int, str]]:
    query = {"sort": "number:asc", "limit": limit} | ({"after": after} if after else {})
    with urllib.request.urlopen(f"{url}/notes?{urllib.parse.urlencode(query)}", timeout=CALL_TIMEOUT) as r:
        return [(n["id"], n["number"], json.dumps(n.get("content", {}))) for n in json.load(r)["notes"]]


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.limit = options["url"], int(options.get("pageSize", 100))

    def initialOffset(self) -> dict:
        return {"after": None}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = note_page(self.url, start["after"], self.limit)
        return iter(rows), {"after": rows[-1][0]} if rows else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        after = start["after"]
        while after != end["after"]:
            rows = note_page(self.url, after, self.limit)
            if not rows:
                return
            for row in rows:
                yield row
                if row[0] == end["after"]:
                    return
            after = rows[-1][0]


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        after = self.options.get("after")
        while rows := note_page(self.options["url"], after, int(self.options.get("pageSize", 100))):
            yield from rows
            after = rows[-1][0]


class NoteFeed(DataSource):
    """``spark.read`` or ``spark.readStream`` ``.format("notes").option("url", ...)``; pages are read one after another, as ``after`` demands."""

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # type: ignore[no-untyped-def]
        return _Batch(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # type: ignore[no-untyped-def]
        return _Stream(self.options)


def note_range(url: str, start: int, stop: int, page: int) -> Iterator[tuple[str, int, str]]:
    """The notes of places [start, stop) in order of their numbers."""
    while start < stop:
        query = {"sort": "number:asc", "offset": start, "limit": min(page, stop - start)}
        with urllib.request.urlopen(f"{url}/notes?{urllib.parse.urlencode(query)}", timeout=CALL_TIMEOUT) as r:
            rows = json.load(r)["notes"]
        if not rows:
            raise ValueError(f"{url} has no notes from place {start} on, though it said so")
        yield from ((n["id"], n["number"], json.dumps(n.get("content", {}))) for n in rows)
        start += len(rows)


def note_count(url: str) -> int:
    with urllib.request.urlopen(f"{url}/notes?{urllib.parse.urlencode({'sort': 'number:asc', 'offset': 0, 'limit': 1})}", timeout=CALL_TIMEOUT) as r:
        return int(json.load(r)["count"])


class _Places(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Ranges:
    """What batch and stream share: the feed's places are cut into ranges, which tasks read page by page."""

    def __init__(self, options: dict[str, str]):
        self.url, self.page = options["url"], int(options.get("pageSize", 100))
        self.share, self.most, self.progress = self.page * int(options.get("pagesPerTask", 10)), int(options.get("maxPerBatch", 0)), options.get("progress", "")
        if self.most and not self.progress:
            raise ValueError("maxPerBatch needs progress, the address of a file that outlives the query")

    def cut(self, start: int, stop: int) -> list[_Places]:
        return [_Places(at, min(at + self.share, stop)) for at in range(start, stop, self.share)]

    def read(self, partition: _Places) -> Iterator[tuple]:
        return note_range(self.url, partition.start, partition.stop, self.page)


class _RangeBatch(_Ranges, DataSourceReader):
    def partitions(self) -> list[_Places]:
        return self.cut(0, note_count(self.url)) or [_Places(0, 0)]


class _RangeStream(_Ranges, DataSourceStreamReader):
    """Offsets are places.  A batch has at most ``maxPerBatch`` notes, counted from the end of the batch planned before it.

    Spark doesn't tell a reader that is started again where that was, so each plan is recorded in the file ``progress``, before the batch runs; a batch that is done again is planned again.
    """

    planned: int | None = None

    def _file(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.progress if "://" in self.progress else f"file://{self.progress}")

    def initialOffset(self) -> dict:
        return {"place": 0}

    def latestOffset(self) -> dict:
        there = note_count(self.url)
        if not self.most:
            return {"place": there}
        if self.planned is None:
            fs, path = self._file()
            known = fs.get_file_info(path).type == pafs.FileType.File
            if known:
                with fs.open_input_stream(path, compression=None) as f:
                    self.planned = int(f.read())
        self.planned = max(self.planned or 0, min(there, (self.planned or 0) + self.most))
        return {"place": self.planned}

    def partitions(self, start: dict, end: dict) -> list[_Places]:
        if self.most:
            fs, path = self._file()
            with fs.open_output_stream(path, compression=None) as f:
                f.write(str(end["place"]).encode())
            self.planned = end["place"]
        return self.cut(start["place"], end["place"])

    def commit(self, end: dict) -> None:
        """Nothing is held for batches that are over."""


class NoteRanges(DataSource):
    """``.format("note_ranges")``, batch or stream, with options url, pageSize, pagesPerTask, and for a stream maxPerBatch with progress: for a service that tells its ``count`` and takes an ``offset``.

    Executors read, each its ranges of places; notes are only added, with rising numbers, so a range read again has the same notes.
    """

    @classmethod
    def name(cls) -> str:
        return "note_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # type: ignore[no-untyped-def]
        return _RangeBatch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # type: ignore[no-untyped-def]
        return _RangeStream(self.options)


def register_note_feed(spark: SparkSession) -> None:
    spark.dataSource.register(NoteFeed)
    spark.dataSource.register(NoteRanges)
    spark.dataSource.register(Outbox)


def rewrite_after_error(message: str) -> str | None:
    """The address to try next, if the error names one that is rewritten."""
    for guard, mark in (("/arxiv.org/abs", "arxiv.org/abs/"), ("/doi.org/", "arXiv.")):
        if guard in message and mark in message:
            return ENTRY_QUERY + message.rpartition(mark)[2].split()[0].rstrip(".,)")
    return None


def fetch_one(url: str, get: Callable[[str], tuple], tries: int = 3) -> tuple[str | None, str | None, str | None, tuple[str, str] | None, dict]:
    """(response_url, status, body, control, more): an error whose message holds a rewritten address leads there; else the fetch halts.

    ``get`` gives (response_url, status, body) and, if it likes, a dict of ``headers``, ``request_headers``, ``frames`` and ``chain``.
    """
    for _ in range(tries):
        try:
            found = get(url)
            return (*found[:3], None, found[3] if len(found) > 3 else {})
        except (OSError, ValueError) as e:
            following = rewrite_after_error(f"{e} at {url}")
            if following is None or following == url:
                return None, None, None, ("halt", str(e)), {}
            url = following
    return None, None, None, ("halt", "too many rewritings"), {}


class _Redirects(urllib.request.HTTPRedirectHandler):
    def __init__(self) -> None:
        self.chain: list[str] = []

    def redirect_request(self, req, fp, code, msg, headers, newurl):  # type: ignore[no-untyped-def]
        self.chain.append(newurl)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def no_fetch(url: str) -> tuple[str, str, str]:
    """In place of ``http_get``: nothing is fetched, and every page is empty."""
    return url, "", ""


def http_get(url: str) -> tuple[str, str, str, dict]:
    redirects = _Redirects()
    request = urllib.request.Request(url)
    opener = urllib.request.build_opener(redirects)
    try:
        answer = opener.open(request, timeout=PAGE_TIMEOUT)
    except urllib.error.HTTPError as e:  # an answer too
        answer = e
    with answer:
        more = {"headers": dict(answer.headers.items()), "request_headers": dict(request.header_items()), "chain": redirects.chain}
        return answer.url, str(answer.status), answer.read().decode("utf-8", "replace"), more


def fetch(urls: DataFrame, get: Callable[[str], tuple] = http_get) -> DataFrame:
    """Fetched pages of the column ``url``; a failure is a row with its control. Partitions bound how many run at once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for u in frame["url"]:
                if u is not None:
                    where, status, body, failed, more = fetch_one(u, get)
                    control = None if failed is None else {"code": failed[0], "msg": failed[1]}
                    rows.append((u, where, status, body, control, more.get("headers", {}), more.get("request_headers", {}), more.get("frames", []), more.get("chain", []), pd.Timestamp.now("UTC")))
            columns = "url response_url status body control headers request_headers frames chain fetched_at".split()
            out = pd.DataFrame(rows, columns=columns)
            yield out.assign(fetched_at=pd.to_datetime(out["fetched_at"], utc=True))

    return urls.select("url").mapInPandas(run, FETCHED)


def post(rows: DataFrame, send: Callable[[dict], None], tries: int = 2) -> DataFrame:
    """(noteId, fieldType, control): hands each row of ``outbox`` to ``send``, again after an error; what still fails has a control.

    The body's ``id`` is a hash of note, field and value, so that a service can tell a repeat; run it once, from a table or a checkpoint.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                failed = None
                for _ in range(max(1, tries)):
                    try:
                        send(json.loads(r["body"]))
                        failed = None
                        break
                    except (OSError, ValueError) as e:
                        failed = {"code": "continue", "msg": str(e)}
                out.append((r["noteId"], r["fieldType"], failed))
            yield pd.DataFrame(out, columns=["noteId", "fieldType", "control"])

    return rows.select("noteId", "fieldType", "body").mapInPandas(run, "noteId string, fieldType string, control struct<code:string,msg:string>")


class _Delivered(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class _Poster(DataSourceStreamWriter):
    """Posts the rows of a batch; what has been delivered is on record, row by row, and isn't posted again.

    A task keeps its record below ``ledger/<batch>`` as it goes: a file of ids that is written anew after each ``every`` posts and at the end, also if a post fails.  A batch that is run
    again reads what all tries of it have recorded.  A task that dies outright may have posted up to ``every`` rows without a record; their bodies' ids let the service tell.
    """

    def __init__(self, options: dict[str, str]):
        self.url, self.ledger, self.every = options["url"], options["ledger"].rstrip("/"), int(options.get("every", 1))
        self.user, self.password = options.get("user"), options.get("password")

    def write(self, iterator: Iterator) -> WriterCommitMessage:  # type: ignore[override]
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(self.ledger if "://" in self.ledger else f"file://{self.ledger}")
        context, service = TaskContext.get(), Service(self.url, self.user, self.password)
        batch = context.getLocalProperty("streaming.sql.batchId") if context else None
        folder = f"{root}/{batch}"
        fs.create_dir(folder, recursive=True)
        done: set[str] = set()
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            with fs.open_input_stream(info.path, compression=None) as f:
                done |= set(f.read().decode().split())
        own, path = [], f"{folder}/{uuid.uuid4().hex}"

        def record() -> None:
            if own:
                with fs.open_output_stream(path, compression=None) as f:
                    f.write("\n".join(own).encode())

        try:
            for row in iterator:
                body = json.loads(row["body"])
                if body["id"] not in done:
                    service.post_edit(body)
                    done.add(body["id"])
                    own.append(body["id"])
                    if len(own) % self.every == 0:
                        record()
        finally:
            record()
        return _Delivered([path] if own else [])

    def commit(self, messages: list, batchId: int) -> None:
        """The batch is over and won't come again; records of batches before it go."""
        fs, root = pafs.FileSystem.from_uri(self.ledger if "://" in self.ledger else f"file://{self.ledger}")
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.base_name.isdigit() and int(info.base_name) < batchId:
                fs.delete_dir(info.path)

    def abort(self, messages: list, batchId: int) -> None:
        """The records stay for the next try."""


class Outbox(DataSource):
    """``stream.writeStream.format("outbox")`` with options url, ledger (a shared folder), user, password, every: posts what ``outbox`` gives, each id once."""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def schema(self) -> str:
        return "noteId string, fieldType string, body string"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # type: ignore[no-untyped-def]
        return _Poster(self.options)


class Service:
    """A note service: logs in once a worker, and posts JSON with that token; a refused login is no token, as with a service that is open."""

    def __init__(self, url: str, user: str | None = None, password: str | None = None):
        self.url, self.user, self.password, self.token = url.rstrip("/"), user, password, None

    def call(self, path: str, body: dict | None = None, **query: object) -> dict:
        address = f"{self.url}/{path}" + (f"?{urllib.parse.urlencode(query)}" if query else "")
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        request = urllib.request.Request(address, json.dumps(body).encode() if body is not None else None, headers)
        with urllib.request.urlopen(request, timeout=CALL_TIMEOUT) as r:
            return json.loads(r.read() or b"{}")

    def login(self) -> str | None:
        if self.token is None and self.user:
            try:
                self.token = self.call("login", {"id": self.user, "password": self.password}).get("token")
            except (OSError, ValueError):
                self.token = None
        return self.token

    def post_edit(self, body: dict) -> None:
        self.login()
        self.call("notes/edits", body)

    def post_message(self, subject: str, text: str, to: list[str]) -> None:
        self.login()
        self.call("messages", {"subject": subject, "message": text, "groups": to})


def outbox(changed: DataFrame, poster: str) -> DataFrame:
    """The edits to post, a row each, as JSON: what a sink sends or a test reads."""
    key = F.sha1(F.concat_ws("\x1f", "noteId", "fieldType", "value"))
    body = F.to_json(F.struct(key.alias("id"), "noteId", F.struct(F.col("fieldType").alias("name"), F.col("value").alias("value")).alias("field"), F.lit(poster).alias("signature")))
    return changed.select("noteId", "fieldType", body.alias("body"))

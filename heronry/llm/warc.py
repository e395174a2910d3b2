"""Pages as WARC 1.1 archives that are read by an index.

Writing: each record is a gzip member of its own, so that it can be read alone.  Of equal payloads one page is a response, the others are
revisits with headers only.  With the records a task writes their index: file, offset, length, type, page, URL, payload digest and size.
Reading: the index comes first.  The records selected from it are sorted by place and neighbours are coalesced into byte ranges of bounded
size, which are dealt to tasks; a task reads a range at once and takes its records from it.

Fields beyond the standard's: ``Page-ID`` and ``Refers-To-Page-ID``.  Each task writes files under names of its own and the index names only those of
tasks that ended well, so a task that is run again leaves nothing half-written in the result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm.common import Workspace, bound_batches, give_back
from heronry.operators.ranges import null_safe_join

#: A file ends after about so many bytes; so many records at most are in one row of revisits.
FILE_BYTES, COPIES = 1_000_000_000, 65_536
#: Records are read together over gaps up to GAP bytes, as ranges of about RANGE bytes.
GAP, RANGE = 65_536, 8_000_000
#: Fixed values of the standard.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "path string, offset long, length long, record_type string, page_id long, url string, payload_digest string, payload_bytes long"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None, url: str | None, digest: str, copy: int | str = 0) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr((page_id, url, digest, copy)).encode(), usedforsecurity=False).digest())}>"


def record(kind: str, fields: dict[str, str | int | None], block: bytes = b"") -> bytes:
    """A record; fields that are None are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in ({"WARC-Type": kind} | fields | {"Content-Length": len(block)}).items() if v is not None)
    return b"".join([f"{VERSION}\r\n{head}\r\n".encode(), block, b"\r\n\r\n"])


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record; raises if it isn't whole."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields.get("Content-Length", -1))
    if not found or lines[0] != VERSION or n < 0 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a damaged record")
    return fields, rest[:n]


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


class Archive:
    """Writes records to files of a folder, each a gzip member; ``index`` has a row a record."""

    def __init__(self, folder: str, date: str, level: int, file_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.date, self.level, self.most, self.out, self.path, self.at, self.index = date, level, file_bytes, None, "", 0, []

    def _put(self, data: bytes) -> tuple[int, int]:
        pack = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = pack.compress(data) + pack.flush()
        self.out.write(member)
        self.at += len(member)
        return self.at - len(member), len(member)

    def add(self, page_id: int | None, url: str | None, sha1: bytes, n_bytes: int, payload: bytes | None, to: tuple | None, copy: int) -> None:
        """A response with its payload, or without one a revisit of ``to`` (page_id, url).  Copy 0 is the response that revisits name, -1 one that none does."""
        if self.out is None or self.at >= self.most:
            self.close()
            self.path, self.at = f"{self.root}/{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.fs.open_output_stream(self.path, compression=None)
            self._put(record("warcinfo", {"WARC-Record-ID": record_id(None, self.path, ""), "WARC-Date": self.date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
        safe = lambda u: None if u is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", u)
        digest, kind = base32(sha1), "revisit" if payload is None else "response"
        fields = {"WARC-Record-ID": record_id(page_id, url, digest, copy if copy >= 0 else f"{self.path}:{self.at}"), "WARC-Date": self.date, "WARC-Target-URI": safe(url), "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response", "Page-ID": page_id}
        if payload is None:
            fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(*to, digest), "WARC-Refers-To-Target-URI": safe(to[1]), "WARC-Refers-To-Date": self.date, "Refers-To-Page-ID": to[0]}
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
        self.index.append((self.path, *self._put(record(kind, fields, http + (payload or b""))), kind, page_id, url, digest, n_bytes))

    def take_index(self) -> Iterator[pa.RecordBatch]:
        if self.index:
            kinds = ("string", "int64", "int64", "string", "int64", "string", "string", "int64")
            names = [f.split()[0] for f in INDEX.split(", ")]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*self.index, strict=True), kinds, strict=True)], names)
            self.index = []

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def decided(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, key, sha1, payload_bytes, n, to, first, alone): distinct pages without their payloads, how many rows each has, and the page that is the response.

    Of equal payloads (by SHA-256) of at least ``least`` bytes that is the page of the largest page_id, null below all, of equal ones the largest url; it is ``first``.
    Smaller payloads are ``alone``: each is a response.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.unhex(F.sha2(payload, 256)).alias("key"), F.unhex(F.sha1(payload)).alias("sha1"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    once = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    once = Workspace(pages.sparkSession, "pages").settle(once, "pages")
    largest = once.groupBy("key").agg(F.max(F.struct("page_id", "url")).alias("to"))
    return once.join(largest, "key").withColumns({"first": F.struct("page_id", "url").eqNullSafe(F.col("to")), "alone": F.col("payload_bytes") < least})


def write_warc(pages: DataFrame, folder: str, least: int = 0, date: str = "2000-01-01T00:00:00Z", level: int = 3, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of (page_id, url, html) below ``folder`` and return the index (``INDEX``) of all; see ``decided`` for which are responses.

    Null html is empty, null ids and urls have no field, and control characters and spaces of a url are percent-encoded in the archive.  Rows that are repeated are records of their own: one response and
    revisits of it.  An empty table writes nothing.  Payloads are shuffled once, by page and content, so that a common payload is dealt like any other.
    """
    spark = pages.sparkSession
    work = Workspace(spark, "warc")
    marks = work.settle(decided(pages, least), "marks")
    key = ["page_id", "url", "key"]
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.unhex(F.sha2(body, 256)).alias("key"), body.alias("payload"))
    told = lambda cond: marks.where(cond).select(*key, "sha1", "payload_bytes", "alone")
    null = F.lit(None).cast("long")
    response = lambda d: d.select("page_id", "url", "sha1", "payload_bytes", "payload", null.alias("to_page"), F.lit(None).cast("string").alias("to_url"), F.when(F.col("alone"), -1).otherwise(0).cast("long").alias("start"), F.lit(1).alias("copies"))
    records = response(null_safe_join(whole, told("alone or (first and n = 1)"), key, "inner"))
    repeated = told("first and not alone and n > 1")
    if not repeated.isEmpty():
        # one of equal rows, found by pre-aggregation
        own = null_safe_join(whole, repeated, key, "inner").groupBy("page_id", "url", "sha1", "payload_bytes", "alone").agg(F.first("payload").alias("payload"))
        records = records.union(response(own))
    revisits = marks.where("not alone").withColumn("n", F.col("n") - F.col("first").cast("long")).where("n > 0")
    revisits = revisits.select("page_id", "url", "sha1", "payload_bytes", "to", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))).alias("start"))
    revisits = revisits.select("page_id", "url", "sha1", "payload_bytes", F.lit(None).cast("binary").alias("payload"), F.col("to.page_id").alias("to_page"), F.col("to.url").alias("to_url"), (F.col("start") * COPIES).cast("long").alias("start"), "n")
    revisits = revisits.repartition("page_id", "url", "start").withColumn("copies", F.least(F.col("n") - F.col("start"), F.lit(COPIES)).cast("int")).drop("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(folder, date, level, file_bytes)
        for batch in batches:
            for k in range(batch.num_rows):
                page, url, sha1, n, payload, to_page, to_url, start, copies = (c[k].as_py() for c in batch.columns)
                for copy in range(start, start + copies):
                    archive.add(page, url, sha1, n, payload, (to_page, to_url), copy + 1 if payload is None else copy)
                    if len(archive.index) >= 10_000:
                        yield from archive.take_index()
            yield from archive.take_index()
        archive.close()
        give_back()

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    bound_batches(spark)
    return work.settle(records.union(revisits).mapInArrow(run, INDEX), "index")


def byte_ranges(index: DataFrame, gap: int = GAP, most: int = RANGE) -> DataFrame:
    """(path, start, stop, places array<struct<offset, length>>): the records' places, sorted and coalesced over gaps of up to ``gap`` bytes.

    A range ends where the next record begins in another block of ``most`` bytes.  Repeated rows of the index are read once.
    """
    w = Window.partitionBy("path").orderBy("offset")  # a file, which is of bounded size
    block = lambda c: F.floor(c / most)
    end, before = F.lag(F.col("offset") + F.col("length")).over(w), F.lag("offset").over(w)
    cut = end.isNull() | (F.col("offset") - end > gap) | (block(F.col("offset")) != block(before))
    numbered = index.select("path", "offset", "length").distinct().withColumn("_cut", cut.cast("int")).withColumn("_k", F.sum("_cut").over(w))
    return numbered.groupBy("path", "_k").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("places")).drop("_k")


def read_warc(index: DataFrame, folder: str, payload: bool = True, gap: int = GAP, most: int = RANGE) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of the records that ``index`` has rows of, from the archives below ``folder``.

    Size and digest are of the payload as read, for revisits (whose payload is null here) those that the record states.  A record that is damaged, or whose payload isn't the one of its
    digest, is an error.  Nothing selected gives no rows.
    """
    spark = index.sparkSession
    kinds = {"page_id": "int64", "url": "string", "payload_bytes": "int64", "payload_digest": "string", "record_type": "string", "refers_to": "int64"} | ({"payload": "binary"} if payload else {})

    def one(data: bytes) -> tuple:
        fields, block = parsed(zlib.decompress(data, 31))
        head, _, body = block.partition(b"\r\n\r\n")
        digest, kind, number = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], lambda k: int(fields[k]) if k in fields else None
        if kind == "response":
            if base32(hashlib.sha1(body, usedforsecurity=False).digest()) != digest:
                raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
            n = len(body)
        else:
            n, body = int(re.search(rb"(?m)^Content-Length: (\d+)", head)[1]), None
        return (number("Page-ID"), fields.get("WARC-Target-URI"), n, digest, kind, number("Refers-To-Page-ID"), *([body] if payload else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start, stop, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(path) as file:
                    data = file.read_at(stop - start, start)
                rows = [one(data[p["offset"] - start : p["offset"] - start + p["length"]]) for p in places]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))
        give_back()

    bound_batches(spark)
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(3 * spark.sparkContext.defaultParallelism, -(-total // (8 * most)))
    return byte_ranges(index, gap, most).repartition(tasks, "path", "start").mapInArrow(run, ", ".join(f"{n} {t.replace('int64', 'long')}" for n, t in kinds.items()))


def archive_and_read(pages: DataFrame) -> DataFrame:
    """A record for each page, written below the shared folder and read back: ``read_warc`` of ``write_warc``, with nulls, repeated rows, ties and empty tables as there.

    The archives stay in the shared folder until ``heronry.llm.common.release``.
    """
    folder = Workspace(pages.sparkSession, "archive").root
    if "://" not in folder:  # a plain path, or file:/path
        folder = "file://" + folder.removeprefix("file:")
    return read_warc(write_warc(pages, folder), folder, payload=False).drop("url")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, url FROM pages),
d AS (SELECT *, sha1(html) AS h, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) = 1 AS first, max(page_id) OVER (PARTITION BY html) AS most FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h || '0', 1 + (5 * i // 4)::INT, 2))::INT >> (3 - 5 * i % 4)::INT) & 31)), 1)), '') AS payload_digest,
 CASE WHEN first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT first THEN most END AS refers_to FROM d"""

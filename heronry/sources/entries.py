"""Corpus entries as a sink: text and JSON files, read-modify-write, folders, and the artefacts of a response.

Entries lie at ``root/h0/h1/h2/<hash>.d/`` (see ``corpus.entry_dir``).  A row of files is written where it lies, in Arrow batches; a file is written under a name of
its own and then moved, so a task that is lost or run again leaves no half of one.  Any file system that pyarrow opens by its address will do.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from heronry.sources.corpus import ARTIFACT_DIRS, entry_dir

FILES = "entry string, subdir string, name string, written boolean"


class _Folder:
    """Files below a root, by relative paths."""

    def __init__(self, root: str):
        self.fs, self.root = pafs.FileSystem.from_uri(root if "://" in root else f"file://{root.removeprefix('file:')}")

    def path(self, *parts: str) -> str:
        if any(".." in p.split("/") or p.startswith("/") for p in parts):
            raise ValueError(f"{'/'.join(parts)} is outside the corpus")
        return "/".join([self.root, *(p for p in parts if p not in ("", "."))])

    def exists(self, path: str) -> bool:
        return self.fs.get_file_info(path).type != pafs.FileType.NotFound

    def read(self, path: str) -> bytes | None:
        if not self.exists(path):
            return None
        with self.fs.open_input_stream(path, compression=None) as f:
            return f.read()

    def write(self, path: str, data: bytes, overwrite: bool) -> bool:
        if not overwrite and self.exists(path):
            return False
        folder, _, name = path.rpartition("/")
        self.fs.create_dir(folder, recursive=True)
        draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft, compression=None) as f:
            f.write(data)
        if not overwrite and self.exists(path):  # another writer was first
            self.fs.delete_file(draft)
            return False
        self.fs.move(draft, path)
        return True


def _subdir(name: str) -> str:
    if name not in ARTIFACT_DIRS:
        raise ValueError(f"{name} is no artefact folder")
    return name


def _each(df: DataFrame, root: str, step: Callable[[_Folder, dict], bool]) -> DataFrame:
    """(entry, subdir, name, written) of ``step`` on each row with an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _Folder(root)
        for batch in batches:
            rows = [r for r in batch.to_pylist() if r["entry"] is not None]
            done = [step(folder, r) for r in rows]
            columns = [pa.array([r[n] for r in rows], "string") for n in ("entry", "subdir", "name")]
            yield pa.record_batch([*columns, pa.array(done, "bool")], ["entry", "subdir", "name", "written"])

    return df.mapInArrow(run, FILES)


def write_texts(files: DataFrame, root: str, overwrite: bool = False) -> DataFrame:
    """Writes (entry, subdir, name, content); a file that is there stays as it is unless ``overwrite``.

    Returns (entry, subdir, name, written), to be run by an action; rows without entry or content write nothing and give no row or ``written`` false.
    """
    return _each(
        files.select("entry", "subdir", "name", "content"), root,
        lambda to, r: r["content"] is not None and to.write(to.path(r["entry"], _subdir(r["subdir"]), r["name"]), r["content"].encode(), overwrite),
    )


class _Placed(WriterCommitMessage):
    def __init__(self, written: int, kept: int):
        self.written, self.kept = written, kept


class _EntryWriter(DataSourceArrowWriter):
    """Files of a task are drafts in a folder of the job's until all its rows are there, then they are moved to their places; a task that fails leaves nothing in sight.

    The driver only counts: a job that ends well leaves a report, one that fails has its drafts removed.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root, self.overwrite, self.job = options["root"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        to, moves = _Folder(self.root), []
        drafts = to.path("_drafts", self.job, uuid.uuid4().hex)
        to.fs.create_dir(drafts, recursive=True)
        kept = 0
        for batch in iterator:
            for r in batch.select(["entry", "subdir", "name", "content"]).to_pylist():
                if r["entry"] is None or r["content"] is None:
                    continue
                path = to.path(r["entry"], _subdir(r["subdir"]), r["name"])
                if not self.overwrite and to.exists(path):
                    kept += 1
                    continue
                draft = f"{drafts}/{len(moves)}"
                with to.fs.open_output_stream(draft, compression=None) as f:
                    f.write(r["content"].encode())
                moves.append((draft, path))
        for draft, path in moves:
            to.fs.create_dir(path.rpartition("/")[0], recursive=True)
            to.fs.move(draft, path)
        to.fs.delete_dir(drafts)
        return _Placed(len(moves), kept)

    def _ended(self) -> _Folder:
        to = _Folder(self.root)
        drafts = to.path("_drafts", self.job)
        if to.exists(drafts):
            to.fs.delete_dir(drafts)
        return to

    def commit(self, messages: list) -> None:
        report = {"written": sum(m.written for m in messages), "kept": sum(m.kept for m in messages)}
        to = self._ended()
        to.write(to.path("_reports", f"{self.job}.json"), json.dumps(report).encode(), True)

    def abort(self, messages: list) -> None:
        self._ended()


class EntryFiles(DataSource):
    """``df.write.format("entries").option("root", ...).mode("append" or "overwrite").save()`` of (entry, subdir, name, content).

    Appending leaves a file that is there as it is.  ``reports`` has the counts of each job that ended well.  Rows without entry or content write nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "entries"

    def schema(self) -> str:
        return "entry string, subdir string, name string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # type: ignore[no-untyped-def]
        return _EntryWriter(self.options, overwrite)


def register_entries(spark: SparkSession) -> None:
    spark.dataSource.register(EntryFiles)


def reports(spark: SparkSession, root: str) -> DataFrame:
    """(written, kept) of the jobs that wrote entries below ``root``."""
    return spark.read.schema("written long, kept long").json(f"{root}/_reports")


def write_json(files: DataFrame, root: str, value: Column, overwrite: bool = False) -> DataFrame:
    """As ``write_texts`` with a struct, map or array column as JSON."""
    return write_texts(files.withColumn("content", F.to_json(value)), root, overwrite)


def update_json(entries: DataFrame, root: str, name: str, change: Callable[[dict | None, dict], dict], subdir: str = ".") -> DataFrame:
    """Read-modify-write of one JSON file an entry: ``change`` gets what is there (None if nothing is) and the row, and
    its result is written if it differs.  Rows of one entry must lie together: they are brought to one partition and come in turn.
    """
    _subdir(subdir)

    def step(to: _Folder, r: dict) -> bool:
        path = to.path(r["entry"], subdir, name)
        raw = to.read(path)
        before = json.loads(raw) if raw is not None else None
        after = change(before, {k: v for k, v in r.items() if k not in ("subdir", "name")})
        return after != before and to.write(path, json.dumps(after).encode(), True)

    others = [c for c in entries.columns if c not in ("subdir", "name")]
    return _each(entries.select(*others, F.lit(subdir).alias("subdir"), F.lit(name).alias("name")).repartition("entry"), root, step)


def read_json(entries: DataFrame, root: str, name: str, subdir: str = ".") -> DataFrame:
    """(entry, content): the file as text, null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _Folder(root)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [folder.read(folder.path(e, subdir, name)) if e is not None else None for e in ids]
            yield pa.record_batch([pa.array(ids, "string"), pa.array([x.decode() if x is not None else None for x in found], "string")], ["entry", "content"])

    return entries.select("entry").mapInArrow(run, "entry string, content string")


def ensure_dirs(entries: DataFrame, root: str, subdirs: tuple[str, ...] = ARTIFACT_DIRS) -> DataFrame:
    """Creates the artefact folders of entries; ``written`` says whether one was missing."""

    def step(to: _Folder, r: dict) -> bool:
        path = to.path(r["entry"], _subdir(r["subdir"]))
        missing = not to.exists(path)
        to.fs.create_dir(path, recursive=True)
        return missing

    d = entries.select("entry", F.explode(F.array(*map(F.lit, subdirs))).alias("subdir")).withColumn("name", F.lit(""))
    return _each(d, root, step)


def clean_entries(entries: DataFrame, root: str) -> DataFrame:
    """Empties the folders of entries; what isn't named as an entry is left alone."""

    def step(to: _Folder, r: dict) -> bool:
        if not re.search(r"(^|/)[0-9a-f]{40}\.d\Z", r["entry"]):
            return False
        path = to.path(r["entry"])
        if to.exists(path):
            to.fs.delete_dir_contents(path)
        else:
            to.fs.create_dir(path, recursive=True)
        return True

    return _each(entries.select("entry", F.lit(".").alias("subdir"), F.lit("").alias("name")), root, step)


def response_files(fetched: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(entry, subdir, name, content) of fetched pages: body, metadata with the chain of redirects, headers, frames; rows that failed have none.

    Expects what ``feeds.fetch`` gives; frames are written whole, one file each.  ``keep`` names columns that each file of a row takes along.
    """
    ok = fetched.where("control is null")
    link = lambda a, b: F.struct(a.alias("requestUrl"), b.alias("responseUrl"), F.col("status"), F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))
    own = link(F.col("url"), F.col("response_url"))
    chain = F.transform(F.filter("chain", lambda x: x != F.col("response_url")), lambda x: F.struct(F.col("url").alias("requestUrl"), x.alias("responseUrl"), F.col("status").alias("status"), own["timestamp"].alias("timestamp")))
    metadata = F.struct(*(own[k].alias(k) for k in ("requestUrl", "responseUrl", "status", "timestamp")), chain.alias("fetchChain"))
    file = lambda name, content: F.struct(name.alias("name"), content.alias("content"))
    fixed = F.array(file(F.lit("response-body"), F.col("body")), file(F.lit("metadata.json"), F.to_json(metadata)), file(F.lit("request-headers.json"), F.to_json("request_headers")), file(F.lit("response-headers.json"), F.to_json("headers")))
    frames = F.transform("frames", lambda x, i: file(F.concat(F.lit("response-frame-"), i.cast("string")), x))
    every = F.explode(F.concat(fixed, F.coalesce(frames, F.slice(fixed, 1, 0)))).alias("f")
    return ok.select(*keep, entry_dir(F.col("url")).alias("entry"), F.lit(".").alias("subdir"), every).select(*keep, "entry", "subdir", "f.name", "f.content").where("content is not null")


def one_an_address(fetched: DataFrame, ties: tuple[str, ...] = (), last: bool = False) -> DataFrame:
    """The first (or last) fetch of each address that didn't fail, by ``fetched_at``, then by the columns ``ties``."""
    order = [F.col(c).desc() if last else F.col(c) for c in ("fetched_at", *ties)]
    d = fetched.where("control is null").withColumn("_fetch", F.row_number().over(Window.partitionBy("url").orderBy(*order)))
    return d.where("_fetch = 1").drop("_fetch")


def save_responses(fetched: DataFrame, root: str, overwrite: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """Writes fetched pages as entries that ``corpus.read_pages`` reads.

    Of several fetches of one address the first is written, or the last with ``overwrite`` (see ``one_an_address``), so that all files of an entry
    are of one response, whichever task comes first.
    """
    return write_texts(response_files(one_an_address(fetched, ties, overwrite)), root, overwrite)

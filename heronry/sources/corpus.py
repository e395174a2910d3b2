"""Sources and sinks: the corpus folder, address lists, CSV records, note feeds, write-once tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions.scalars import hash_path
from heronry.functions.urls import is_url

#: An entry's folders and the files in it.
ARTIFACT_DIRS = (".", "spidering-logs", "cache", "ground-truth", "extracted-fields")
RESPONSE_BODIES = r"response-body|response-frame"
ENTRY_PATH = r"[0-9a-f]{40}\.d\z"
CHAIN = "requestUrl string, responseUrl string, status string, timestamp string"
METADATA_SCHEMA = f"{CHAIN}, fetchChain array<struct<{', '.join(x.replace(' ', ':', 1) for x in CHAIN.split(', '))}>>"
NOTE_SCHEMA = "id string, number long, cdate long, mdate long, tcdate long, tmdate long, content struct<abstract:string,pdf:string,html:string,venueid:string,title:string,authors:array<string>>"
CSV_SCHEMA = "note_id string, dblp_key string, title string, url string"


def entry_dir(url: Column, root: str = "") -> Column:
    """The folder of an entry: root, three levels of hash digits, the hash with .d."""
    return F.concat_ws("/", F.lit(root), hash_path(url, 3)) if root else hash_path(url, 3)


def with_entries(urls: DataFrame, root: str) -> DataFrame:
    """``urls`` with what a fetch of each needs: ``initial_url``, ``entry`` and ``entry_path``, the entry's folder below the root."""
    return urls.withColumns({"initial_url": F.col("url"), "entry": entry_dir(F.col("url")), "entry_path": entry_dir(F.col("url"), root.rstrip("/"))})


def valid_entry_path(path: Column) -> Column:
    return F.coalesce(path.rlike(ENTRY_PATH), F.lit(False))


#: Levels of folders that are dealt out to tasks one after another, as many as an entry has hash digits; what is deeper is walked by the task that has it.
LEVELS = 3
#: Names are passed on so many at a time, contents in pieces of about so many bytes.
MOST_NAMES, MOST_BYTES = 2000, 4_000_000


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass over a file or folder of that name."""
    return name.startswith(".") or name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")) or name.endswith("._COPYING_")


def _walked(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of the regular files below ``root``, relative to it; tasks list the folders, so that the driver holds no names."""
    from heronry.sources.entries import _Folder

    schema = "path string, length long"  # a folder that is still to be listed has no length

    def listed(batches: Iterator[pa.RecordBatch], deep: bool) -> Iterator[pa.RecordBatch]:
        to, out = _Folder(root), []
        some = lambda: pa.record_batch([pa.array([p for p, _ in out], "string"), pa.array([n for _, n in out], "int64")], ["path", "length"])
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folders = [path] if length is None else []
                out += [(path, length)] if length is not None else []
                while folders:
                    folder = folders.pop()
                    for found in to.fs.get_file_info(pafs.FileSelector(to.path(folder), allow_not_found=True)):
                        below = f"{folder}/{found.base_name}".lstrip("/")
                        if _hidden(found.base_name):
                            continue
                        if found.type == pafs.FileType.File:
                            out.append((below, found.size))
                        elif found.type == pafs.FileType.Directory and deep:
                            folders.append(below)
                        elif found.type == pafs.FileType.Directory:
                            out.append((below, None))
                        if len(out) >= MOST_NAMES:
                            yield some()
                            out.clear()
        if out:
            yield some()

    d = spark.range(0, 1, 1, 1).select(F.lit("").alias("path"), F.lit(None).cast("long").alias("length"))
    for _ in range(LEVELS):
        d = d.mapInArrow(lambda batches: listed(batches, False), schema).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    # through an RDD, whose size the planner takes for unknown: by the size of these few names it would broadcast all that is found below them
    return spark.createDataFrame(d.rdd, schema).mapInArrow(lambda batches: listed(batches, True), schema)


def _contents(files: DataFrame, root: str) -> DataFrame:
    """(path, content) of files by their paths below ``root``; no more than a piece of them is held at once."""
    from heronry.sources.entries import _Folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, held, size = _Folder(root), [], 0
        some = lambda: pa.record_batch([pa.array([p for p, _ in held], "string"), pa.array([c for _, c in held], "binary")], ["path", "content"])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                content = to.read(to.path(path))
                if content is None:  # removed since it was listed
                    continue
                held.append((path, content))
                size += len(content)
                if size >= MOST_BYTES or len(held) >= MOST_NAMES:
                    yield some()
                    held, size = [], 0
        if held:
            yield some()

    return files.select("path").mapInArrow(read, "path string, content binary")


def _qualified(spark: SparkSession, root: str) -> tuple[str, bool]:
    """The full address of ``root``, and whether it is a folder that pyarrow opens."""
    from heronry.sources.entries import _Folder

    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    try:
        to = _Folder(full)
        return full, to.fs.get_file_info(to.root).type == pafs.FileType.Directory
    except (OSError, ValueError):
        return full, False


def files_below(spark: SparkSession, root: str, name: str = "*", contents: bool = False) -> DataFrame:
    """(path, length), or (path, content) with ``contents``, of the regular files below ``root`` whose names fit the glob ``name``.

    Hidden files and folders are passed over, as Spark's readers do.  Tasks list and read, so that the driver's memory doesn't grow with the number of
    files, and a task holds the names of one folder.  A root that pyarrow doesn't open (patterns, stores that only Spark knows) is left to Spark, whose driver holds all names.
    """
    full, opens = _qualified(spark, root)
    if not opens:
        d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
        return d.select("path", "content" if contents else "length")
    d = _walked(spark, full)
    if name != "*":
        fits = spark._jvm.org.apache.hadoop.fs.GlobPattern(name).compiled().pattern()
        d = d.where(F.element_at(F.split("path", "/"), -1).rlike(rf"(?s)\A(?:{fits})\z"))
    d = _contents(d, full) if contents else d
    return d.withColumn("path", F.concat(F.lit(f"{full.rstrip('/')}/"), "path"))


def list_artifacts(spark: SparkSession, root: str, pattern: str = "", subdir: str = ".") -> DataFrame:
    """(entry, name, path, length) of the regular files below the entries whose names match; contents aren't read."""
    parts = F.split("path", "/")
    d = files_below(spark, root).withColumn("name", F.element_at(parts, -1)).withColumn("folder", F.element_at(parts, -2))
    own = F.col("folder").rlike(ENTRY_PATH) if subdir == "." else F.col("folder") == subdir
    d = d.filter(own & F.col("name").rlike(pattern or ""))
    return d.select(F.regexp_extract("path", r"([0-9a-f]{40})\.d/", 1).alias("entry"), "name", "path", "length")


def read_text(spark: SparkSession, root: str, name: str = "response-body") -> DataFrame:
    """(entry, text) of each entry's file of that name, whole."""
    return files_below(spark, root, name, contents=True).select(F.regexp_extract("path", r"([0-9a-f]{40})\.d/", 1).alias("entry"), F.col("content").cast("string").alias("text"))


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """metadata.json of each entry, with nulls where it isn't JSON."""
    d = read_text(spark, root, "metadata.json").withColumn("text", F.regexp_replace("text", r"\A\uFEFF", "")).where(r"text rlike '\\S'")
    d = d.select("entry", F.from_json("text", f"array<struct<{METADATA_SCHEMA}>>").alias("m"))
    return d.select("entry", F.explode(F.coalesce("m", F.array(F.lit(None)))).alias("m")).select("entry", "m.*")


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, url, status, html): bodies with their metadata."""
    meta = read_metadata(spark, root).select("entry", "responseUrl", "status")
    return read_text(spark, root).join(meta, "entry").select(F.col("entry").alias("page_id"), F.col("responseUrl").alias("url"), "status", F.col("text").alias("html"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def url_list(lines: DataFrame, line: str = "line") -> DataFrame:
    """Trimmed lines that are addresses; comments and empty lines fall out."""
    return lines.select(F.trim(line).alias("url")).filter(is_url(F.col("url")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=CSV_SCHEMA)


RECORD_SCHEMA = "kind string, fields map<string, struct<exists:boolean,count:int,instances:array<struct<name:string,evidence:array<string>,value:string>>>>"


def read_extraction_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD_SCHEMA).json(path, multiLine=True)


def label_report(records: DataFrame) -> DataFrame:
    """(kind, field, records, found, values): how often each field is there and how many values it has."""
    d = records.select("kind", F.explode("fields").alias("field", "f"))
    return d.groupBy("kind", "field").agg(F.count("*").alias("records"), F.sum(F.col("f.exists").cast("long")).alias("found"), F.sum(F.size("f.instances").cast("long")).alias("values"))


def looks_like_markup(body: Column) -> Column:
    """Whether the text begins as HTML or XML does."""
    return F.coalesce(F.lower(F.ltrim(body)).rlike(r"\A(<!doctype|<html|<\?xml|<head|<body)"), F.lit(False))


def mime_of(body: Column) -> Column:
    """The kind of a text by how it begins, as ``type/subtype; charset=...``; null for null."""
    start = F.substring(body, 1, 1024)
    first = F.lower(F.regexp_replace(start, r"\A[\s\uFEFF]+", ""))
    bare = F.regexp_replace(first, r"(?s)\A(?:<!--.*?-->\s*)+", "")
    kinds = (
        (start.startswith("%PDF-"), "application/pdf"), (start.startswith("PK\x03\x04"), "application/zip"), (start.startswith("GIF8"), "image/gif"), (F.substring(start, 2, 3) == "PNG", "image/png"), (start.startswith("%!PS"), "application/postscript"),
        (bare.rlike(r"\A<\?xml[^>]*>\s*(?:<!doctype html|<html)") | bare.rlike(r"\A<(?:!doctype html|html|head|body|title|meta|script|style|table|div|p|h[1-6]|a|br)\b"), "text/html"),
        (bare.rlike(r"\A<(?:\?xml|[a-z_][\w:.-]*(?:\s[^>]*)?>)"), "text/xml"), (first.rlike(r"\A[\[{]") & F.rtrim(body).rlike(r"[\]}]\z"), "application/json"), (body == "", "inode/x-empty"),
    )
    kind = F.lit("text/plain")
    for cond, name in reversed(kinds):
        kind = F.when(cond, F.lit(name)).otherwise(kind)
    charset = F.when(kind.startswith("application/") | kind.startswith("image/") | kind.startswith("inode/"), F.lit("binary")).when(body.rlike(r"[^\x00-\x7F]"), F.lit("utf-8")).otherwise(F.lit("us-ascii"))
    return F.when(body.isNotNull(), F.concat(kind, F.lit("; charset="), charset))


def verify_type(body: Column, pattern: str) -> Column:
    """Whether the kind of the text matches; false for null."""
    return F.coalesce(mime_of(body).rlike(pattern), F.lit(False))


def normalised_bodies(pages: DataFrame, bodies: str = "bodies", pattern: str = r"text/(html|xml)") -> DataFrame:
    """Pages of status 200 with ``normalised``: the tidy text of each of their bodies that is markup; pages without one have a control instead of null."""
    from heronry.operators.extract import tidy_each
    from heronry.operators.flow import control

    out = pages.where("status = '200'").withColumn("normalised", tidy_each(F.filter(bodies, lambda b: verify_type(b, pattern))))
    none = F.coalesce(F.size("normalised") < 1, F.lit(True))
    return out.withColumns({"normalised": F.when(~none, F.col("normalised")), "control": F.when(none, control(F.lit("halt"), F.lit("no body could be normalised")))})


def expand_dir(spark: SparkSession, folder: str) -> DataFrame:
    """(dir, files): the names of a folder's regular files, sorted; one row."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.agg(F.array_sort(F.collect_list("name")).alias("files")).select(F.lit(folder).alias("dir"), "files")


def list_normalised(spark: SparkSession, root: str) -> DataFrame:
    """The artefacts that hold normalised text, in the cache folders."""
    return list_artifacts(spark, root, r"tidy-norm\z", "cache")


def existing_entries(rows: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """The rows whose entry is in the corpus."""
    return rows.join(entries.select(key).distinct(), key, "left_semi")


def characters(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, pos, ch): a row a character."""
    return df.filter(F.length(text) > 0).select(*keys, F.posexplode(F.split(text, "")).alias("pos", "ch"))


def notes_after(notes: DataFrame, after: int | None, page: int) -> DataFrame:
    """One page of a feed sorted by number, after the last one seen."""
    d = notes if after is None else notes.filter(F.col("number") > after)
    return d.orderBy("number").limit(page)


def write_once(df: DataFrame, path: str, keys: list[str], batch: int | str | None = None) -> int:
    """Adds the rows whose keys the table at ``path`` lacks; returns how many. Rows of equal keys count once.

    Rows go to a partition ``batch=<batch>`` of their own, which replaces what an earlier run of the same batch wrote there, so that a run that is lost halfway
    or done again adds nothing twice; without a number each call is a batch.  Of several writers at once, each must have its own batches, and a key
    that two of them bring in the same moment is kept twice.
    """
    spark = df.sparkSession
    batch = uuid.uuid4().hex if batch is None else batch
    new = df.dropDuplicates(keys)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        there = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.select(*keys).schema)}, batch string").parquet(path)
        new = new.join(there.where(F.col("batch") != str(batch)).select(*keys), keys, "left_anti")
    own = f"{path}/batch={batch}"
    new.write.mode("overwrite").parquet(own)
    return spark.read.schema(df.schema).parquet(own).count()


def guarded_table_name(name: str) -> str:
    """Only a database for tests may be emptied."""
    if not re.search(r".+test", name):
        raise ValueError(f"{name} is no test database")
    return name


def reset_tables(spark: SparkSession, database: str, schemas: dict[str, str]) -> None:
    """Drops the tables of a test database and creates them anew, empty."""
    guarded_table_name(database)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, schema in schemas.items():
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")
        spark.createDataFrame([], schema).write.saveAsTable(f"`{database}`.`{name}`")


def mock_status(spark: SparkSession, n: int) -> DataFrame:
    """Rows of a fixed pattern for tests of reports: every third note has a valid address, every ninth an abstract."""
    from heronry.operators.state import WORKFLOW

    i = F.col("number")
    d = spark.range(n).select(F.col("id").alias("number"), F.concat(F.lit("note#"), F.col("id").cast("string")).alias("id"))
    return d.select(
        "id", "number", (i % 3 == 0).alias("validUrl"),
        F.when(i % 3 == 0, F.concat(F.lit("http://host-"), (i % 5).cast("string"), F.lit("/page/"), i.cast("string"))).otherwise(F.lit("no-url")).alias("url"),
        F.concat(F.lit("host-"), (i % 5).cast("string")).alias("responseHost"), (i % 9 == 0).alias("hasAbstract"),
        ((i % 4 + 2) * 100 + i % 3).cast("int").alias("httpStatus"), F.get(F.array(*map(F.lit, WORKFLOW)), (i % len(WORKFLOW)).cast("int")).alias("workflowStatus"),
    )

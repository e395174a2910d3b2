"""Helpers that every training-data operator shares: tables, the shared folder, Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as a column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and runs within one process (tests) a temporary folder is set; on a cluster that raises, since
    executors wouldn't see it.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[[^,]*(,\d+)?\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="heronry-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """From now on the session's Arrow batches have at most ``rows`` rows and about 16 MB, whatever the length of the texts."""
    current = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < current <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows and about 16 MB while plans are run inside, so that wide rows stay within an executor's memory."""
    confs = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
    before = {k: spark.conf.get(k, None) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint, in the session's folder or one that is set now."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Workspace:
    """Tables written to the shared folder to cut lineage; ``drop`` removes one that no plan needs any more.

    What a returned frame is read from stays until ``release``.
    """

    made: list[Workspace] = []

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self.made.append(self)

    def settle(self, df: DataFrame, name: str, codec: str = "zstd", rows: int = 1000, few: bool = False) -> DataFrame:
        """The table, read back.  ``few``: narrow rows are dealt anew to two tasks a core, which write a file each; what comes before keeps its own tasks."""
        path = f"{self.root}/{name}"
        if few:
            df = df.repartition(2 * max(4, self.spark.sparkContext.defaultParallelism))
        with small_batches(self.spark, rows):
            df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Removes all tables and files that this driver's operators have left in the shared folder; frames that were returned can't be read after it."""
    while Workspace.made:
        Workspace.made.pop().drop()


def give_back() -> None:
    """Returns freed memory to the system, so that a Python worker that waits for its next task is small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not everywhere is there such a call
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with state built once a task by ``make`` (vocabularies, memos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if out is not None and out.num_rows:
                    yield out
                del out
        del step
        give_back()

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """One batch for each run of rows with equal first ``keys`` columns (integers without nulls); holds a run at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            own = tuple(values[:, lo].tolist())
            if held and own != last:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = own
    if held:
        yield pa.concat_batches(held)


def pieces(column: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, list]]:
    """Slices of a text column, each of about ``most`` bytes, as (first row, values): bounds what is in Python at once."""
    start, held = 0, 0
    sizes = pc.binary_length(column).fill_null(0).to_pylist()
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, column.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, column.slice(start).to_pylist()


def by_bytes(df: DataFrame, text: str = "text") -> DataFrame:
    """The text as UTF-8 bytes (null: empty), which spares Python the decoding."""
    return df.withColumn(text, F.coalesce(F.col(text), F.lit("")).cast("binary"))

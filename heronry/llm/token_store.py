"""Token ids in seekable zstandard shards.

A shard holds documents in ascending doc_id order, null ids first:

    frame 0 .. frame n-1   one independent zstandard frame a document: its ids as little-endian uint32
    index frame            skippable frame 0x184D2A5D: doc_ids as little-endian int64, then a null flag byte each
    seek table             skippable frame 0x184D2A5E: for each frame compressed size, decompressed size and the low
                           32 bits of the XXH64 of its decompressed bytes, then n, a descriptor byte (0x80) and
                           0x8F92EAB1, as the public zstd seekable format has them

A reader takes the seek table from the end of the file and decompresses only the frames asked for.
Ids come from the tokenizers library through a memo of words (see ``heronry.llm.word_memo``).
"""

from __future__ import annotations

import array
import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm.common import Workspace, checkpointed, pieces
from heronry.llm.word_memo import word_ids

END_ID = 1
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1


#: About as many bytes of text go to a shard, unless there are too few for all cores.
BYTES_PER_SHARD = 256_000_000


def seek_table(entries: np.ndarray) -> bytes:
    """Rows of compressed size, plain size and checksum."""
    body = entries.astype("<u4").tobytes() + struct.pack("<IBI", len(entries), 0x80, FOOTER_MAGIC)
    return struct.pack("<II", SEEK_MAGIC, len(body)) + body


class ShardReader:
    """Random access to the documents of one shard, given as a seekable binary file."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        file.seek(size - 9)
        n, descriptor, magic = struct.unpack("<IBI", file.read(9))
        if magic != FOOTER_MAGIC or descriptor != 0x80:
            raise ValueError("no seek table")
        file.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        file.seek(int(self.offsets[-1]))
        magic, length = struct.unpack("<II", file.read(8))
        if magic != INDEX_MAGIC or length != 9 * n:
            raise ValueError("no index")
        ids, nulls = np.frombuffer(file.read(8 * n), "<i8"), np.frombuffer(file.read(n), "u1")
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, nulls, strict=True)]
        self.unpack = zstandard.ZstdDecompressor()

    def document(self, k: int) -> bytes:
        """The ids of the k-th document as bytes, checked against the frame's checksum."""
        compressed, plain, check = map(int, self.table[k])
        if self.file.tell() != self.offsets[k]:
            self.file.seek(int(self.offsets[k]))
        data = self.unpack.decompress(self.file.read(compressed), max_output_size=max(plain, 1)) if plain else b""
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data


#: Id ranges for each shard whose bytes are counted before they are put together to shards.
FINE = 4


@dataclass(frozen=True)
class Layout:
    """doc_ids that part the shards, and how many shards each range has: one, or for an id with many rows several, by a hash of the text."""

    bounds: list[int]
    widths: list[int]

    @property
    def shards(self) -> int:
        return sum(self.widths)

    def place(self, doc_id: Column, text: Column) -> Column:
        offsets = [sum(self.widths[:i]) for i in range(len(self.widths))]
        if max(self.widths) == 1:
            return shard_of(doc_id, self.bounds)
        at = lambda values: F.get(F.lit(values), shard_of(doc_id, self.bounds))
        return at(offsets) + F.pmod(F.xxhash64(text), at(self.widths)).cast("int")


def layout(docs: DataFrame, bytes_per_shard: int, shards: int | None = None) -> Layout:
    """Shards of about equal bytes, counted from the texts; at least three a core and at most one a document, or ``shards`` of them.

    The bytes of ids are added up, then of ranges of ids, by quantiles of the ids and of about a quarter of a shard, which are put together; what comes to the driver is a row a range,
    and a row an id that alone is more than a shard.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    each = Workspace(docs.sparkSession, "sizes").settle(sizes.groupBy("doc_id").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "sizes")
    total, rows = each.agg(F.sum("bytes"), F.sum("n")).first()
    if not rows:
        return Layout([], [1])
    wanted = shards or max(1, min(rows, max(-(-total // bytes_per_shard), 3 * docs.sparkSession.sparkContext.defaultParallelism)))
    share = max(1, -(-total // wanted))
    hot = sorted((r.doc_id, -(-r.bytes // share)) for r in each.where((F.col("n") > 1) & (F.col("bytes") > 2 * share)).collect() if r.doc_id is not None)
    several = dict(hot)
    fine = sorted({*shard_bounds(each, min(rows, wanted * FINE)), *(i for i, _ in hot), *(i - 1 for i, _ in hot if i > -(2**63))}) if wanted > 1 else []
    held = {r.k: r.b for r in each.groupBy(shard_of(F.col("doc_id"), fine).alias("k")).agg(F.sum("bytes").alias("b")).collect()}
    bounds, widths, full = [], [], 0
    for k in range(len(fine) + 1):
        full += held.get(k, 0)
        alone = k < len(fine) and fine[k] in several and k > 0 and fine[k - 1] == fine[k] - 1
        following = k + 1 < len(fine) and fine[k + 1] in several and fine[k] == fine[k + 1] - 1
        if k < len(fine) and (alone or following or full >= share):
            bounds.append(fine[k])
            widths.append(min(several[fine[k]], rows) if alone else 1)
            full = 0
    return Layout(bounds, [*widths, 1])


def shard_bounds(docs: DataFrame, shards: int) -> list[int]:
    """doc_ids that part the documents into about equal shards, from a read of the id column alone."""
    return sorted(set(map(int, docs.where("doc_id is not null").approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.2 / shards)))) if shards > 1 else []


def shard_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds lie below the id (0 for null), found in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda array: F.size(F.filter(array, lambda b: b < doc_id))
    coarse = below(F.lit([g[-1] for g in groups]))
    fine = below(F.get(F.array(*map(F.lit, groups)), coarse))
    return F.coalesce(F.when(doc_id.isNotNull(), F.when(coarse < len(groups), coarse * step + fine).otherwise(len(bounds))), F.lit(0))


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, shards: int | None = None, level: int = 1, bytes_per_shard: int = BYTES_PER_SHARD) -> DataFrame:
    """Encode (doc_id, text) and write shards to ``folder``; returns (shard, path, n_docs, n_tokens), one row a file.

    A null text is an empty document (only the end id).  Null ids go to the first shard, before all others;
    rows of equal id lie side by side, in several shards if they are more than one can hold.  Each task writes under a name of its own and the row it returns
    names that file, so a task that is run again leaves nothing half-written in the result.
    Texts are dealt out by id once, before encoding; no stage holds more than a slice of a batch and the open shard's frame table, of 21 bytes a document.
    The number of shards follows the bytes of the texts (``bytes_per_shard``) unless it is given, whatever the input was derived from.  An empty table writes nothing.
    """
    parts = layout(docs, bytes_per_shard, shards)
    place = parts.place(F.col("doc_id"), F.col("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, pack = word_ids(tokenizer_path), zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        fs, root = pafs.FileSystem.from_uri(folder)
        shard, out, path, table, ids, nulls, tokens = -1, None, "", array.array("I"), array.array("q"), bytearray(), 0

        def close() -> pa.RecordBatch:
            index = np.array(ids, "<i8").tobytes() + bytes(nulls)
            out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index + seek_table(np.array(table).reshape(-1, 3)))
            out.close()
            return pa.record_batch([pa.array([shard], "int32"), pa.array([path]), pa.array([len(ids)], "int64"), pa.array([tokens], "int64")], ["shard", "path", "n_docs", "n_tokens"])

        for batch in batches:
            doc_ids, places = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for start, texts in pieces(batch.column(2)):
                for k, data in enumerate(memo.encode(texts), start):
                    if places[k] != shard:
                        if out is not None:
                            yield close()
                        shard, table, ids, nulls, tokens = places[k], array.array("I"), array.array("q"), bytearray(), 0
                        path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.zst"
                        out = fs.open_output_stream(path, compression=None)
                    data += struct.pack("<I", END_ID)
                    frame = pack.compress(data)
                    out.write(frame)
                    table.extend((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
                    ids.append(doc_ids[k] or 0)
                    nulls.append(doc_ids[k] is None)
                    tokens += len(data) // 4
        if out is not None:
            yield close()

    dealt = docs.select(place.cast("int").alias("shard"), "doc_id", "text").repartitionById(parts.shards, F.col("shard"))
    return dealt.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first()).mapInArrow(write, "shard int, path string, n_docs long, n_tokens long")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: start counts the ids of all documents before it."""
    files = sorted(manifest.collect(), key=lambda r: r.shard)  # a row a shard: bounded by the number of shards
    rows, before = [], 0
    for f in files:
        rows.append((f.shard, f.path, before))
        before += f.n_tokens
    schema = "shard int, path string, before long"
    todo = spark.createDataFrame(rows, schema).repartitionById(max(1, len(rows)), F.col("shard")) if rows else spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with fs.open_input_file(path) as file:
                    shard = ShardReader(file)
                    for lo in range(0, len(shard.doc_ids), 20_000):
                        ids, data = shard.doc_ids[lo : lo + 20_000], []
                        for k in range(lo, lo + len(ids)):
                            d = shard.document(k)
                            data.append((at, len(d) // 4, zlib.crc32(d)))
                            at += len(d) // 4
                        yield pa.record_batch([pa.array(ids, "int64"), *(pa.array(c, "int64") for c in zip(*data, strict=True))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_and_read(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write all documents below the shared folder and read them back: ``read_tokens`` of ``write_tokens``, with nulls, empty texts, repeated rows and empty tables as there.

    The files stay in the shared folder until ``heronry.llm.common.release``.
    """
    spark = docs.sparkSession
    folder = Workspace(spark, "tokens").root
    if "://" not in folder:  # a plain path, or file:/path
        folder = "file://" + folder.removeprefix("file:")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    manifest = checkpointed(write_tokens(docs, tokenizer_path, folder))  # the files are written once; what follows reads this
    return read_tokens(spark, folder, manifest)

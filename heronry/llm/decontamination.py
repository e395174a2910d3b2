"""Benchmark decontamination: SimHash of item-sized windows, then exact weighted similarity of word shingles.

1. A window as long as an item can only reach the threshold if nearly all its shingles occur in items of that length.  A running count of
   those that don't leaves few windows; the bound is a proven one and drops none that could match.  A text shorter than an
   item is one window, with the bound for the two sizes.  What occurs in items is asked of a bitmap of bounded size, which
   may say yes too often, and so lets a few windows more through, but never no.
2. A window and an item at the threshold have a shingle in common even among the few rarest of each (of m and n shingles with at least c in common, the m - c + 1 and
   n - c + 1 that come first in one order of all; the order is by how many items have a shingle).  So windows meet items in cells of one such shingle and
   bounded size.  There the 128-bit SimHash of a window's shingles, weighted by how often they
   occur, is looked up in a multi-index: 16 blocks of 8 bits.  Of a fingerprint within ``RADIUS`` bits at least one block is within
   RADIUS // 16 bits, and each block's table has the items for all such values; so every item within the radius is found.  At the threshold the distance
   stays within it by five standard deviations.  (Blocks alone would be no key to join on: a radius that wide lets 92 of 100 strangers meet in some block.)
3. The weighted Jaccard similarity (sum of least over sum of greatest counts) of 5-word shingles confirms a match.

The documents are read once, whatever the number of items; only the bitmap and the items' lengths come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.llm.common import Workspace, arrow_map, bound_batches, by_bytes, fresh, give_back, pieces, runs_of
from heronry.llm.words import STEP, WordHashes, grams, mixed

SHINGLE, PERCENT, BITS, RADIUS, BLOCK_BITS = 5, 80, 128, 40, 8
#: A bitmap has about so many bits for each entry, and at most 2 ** MOST_BITS (32 MB).
BITS_A_KEY, MOST_BITS = 16, 28
#: Bits of a bitmap that one row holds on their way to the driver.
CHUNK_BITS = 1 << 15
_U = np.uint64
_LONGS = BITS // 64
#: About so many items and windows meet in a cell at most.
ITEMS, WINDOWS = 2048, 8192


def fingerprints(shingles: np.ndarray) -> np.ndarray:
    """128-bit SimHashes, as two words, of rows of equally many shingle hashes."""
    out = np.empty((len(shingles), _LONGS), _U)
    for half in range(_LONGS):
        h = mixed(np.ascontiguousarray(shingles) + np.array(half + 1, _U) * STEP)
        bits = np.unpackbits(h.view(np.uint8).reshape(*h.shape, 8), axis=-1, bitorder="little")
        out[:, half] = np.packbits(bits.sum(axis=1, dtype=np.int32) * 2 > shingles.shape[1], axis=-1, bitorder="little").view(_U)[:, 0]
    return out


def elements(shingles: np.ndarray) -> np.ndarray:
    """Rows of shingle hashes with each repetition in a row made a value of its own, so that weighted similarity is that of sets."""
    order = np.argsort(shingles, axis=1, kind="stable")
    ranked = np.take_along_axis(shingles, order, axis=1)
    at = np.arange(shingles.shape[1])
    again = np.zeros(shingles.shape, bool)
    again[:, 1:] = ranked[:, 1:] == ranked[:, :-1]
    begins = np.maximum.accumulate(np.where(again, 0, at), axis=1)
    out = np.empty_like(shingles)
    np.put_along_axis(out, order, mixed(ranked + (at - begins).astype(_U) * STEP), axis=1)
    return out


def in_common(m: int, n: int) -> int:
    """Of m and n shingles at least so many are in common where the similarity is at the threshold."""
    return -(-PERCENT * (m + n) // (100 + PERCENT))


def n_shingles(n_words: int) -> int:
    return max(1, n_words - SHINGLE + 1)


def of_length(shingles: np.ndarray, n_words: int) -> np.ndarray:
    """A key for a shingle in items of so many words."""
    return mixed(shingles + _U(n_words * int(STEP) & 0xFFFFFFFFFFFFFFFF))


class Bitmap:
    def __init__(self, bits: bytes):
        self.raw, self.bytes, self.mask = bits, np.frombuffer(bits, np.uint8), _U(8 * len(bits) - 1)

    def has_one(self, key: int) -> int:
        at = key & 8 * len(self.raw) - 1
        return self.raw[at >> 3] >> (at & 7) & 1

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.bytes[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


class KnownWords(WordHashes):
    """Word hashes, 0 for a word that is in no item."""

    def __init__(self, words: Bitmap):
        super().__init__()
        self.words = words

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        value = self[word] = value if self.words.has_one(value) else 0
        return value


class Sieve:
    """Which windows of a text could match an item."""

    def __init__(self, words: bytes, shingles: bytes, lengths: list[int]):
        self.words, self.shingles, self.lengths = KnownWords(Bitmap(words)), Bitmap(shingles), sorted(lengths)
        self.short = [n for n in self.lengths if n < SHINGLE]
        self.long = [n for n in self.lengths if n >= SHINGLE]
        self.bounds: dict[int, int] = {}

    def least(self, n_words: int) -> int:
        """Shingles of items that a text of so many words must hold to match any item of SHINGLE words or more."""
        n_words = min(n_words, self.lengths[-1])  # beyond the longest item all texts are alike
        if n_words not in self.bounds:
            mine = n_shingles(n_words)
            self.bounds[n_words] = min((in_common(min(mine, m), m) for n in self.long if 100 * mine >= PERCENT * (m := n_shingles(n))), default=1 << 30)
        return self.bounds[n_words]

    def windows(self, text: bytes) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
        """(item's words, starts, window's words, shingles a row a window), equal windows of a text only once."""
        hashes = self.words.of(text.lower().split())
        n_words = len(hashes)
        alien = np.concatenate([[0], np.cumsum(hashes == 0)])
        for n in self.short:
            starts = np.flatnonzero(alien[n:] == alien[:-n]) if n_words >= n else np.zeros(0, np.int64)
            if len(starts):
                found = grams(hashes[starts + np.arange(n)[:, None]], n)[0]
                some = self.shingles.has(of_length(found, n))
                yield from self._rows(n, starts[some], n, hashes)
        at = np.flatnonzero(alien[SHINGLE:] == alien[:-SHINGLE])
        least = self.least(n_words)
        if len(at) < least:
            return
        found = grams(hashes[at + np.arange(SHINGLE)[:, None]], SHINGLE)[0]
        some = self.shingles.has(of_length(found, 0))
        at, found = at[some], found[some]
        if len(at) < least:
            return
        for n in self.long:
            m, mine = n_shingles(n), n_shingles(n_words)
            if 100 * mine < PERCENT * m:
                break  # and longer items all the more
            here = at[self.shingles.has(of_length(found, n))]
            if len(here) < in_common(min(mine, m), m):
                continue
            if n > n_words:
                yield from self._rows(n, np.zeros(1, np.int64), n_words, hashes)
                continue
            # intersection / union >= p with m shingles each: at least 2pm/(1+p) in common, so at most this many spoilt
            spoilt = np.ones(mine, np.int32)
            spoilt[here] = 0
            spoilt = np.concatenate([[0], np.cumsum(spoilt)])
            yield from self._rows(n, np.flatnonzero(spoilt[m:] - spoilt[:-m] <= m - in_common(m, m)), n, hashes)

    def _rows(self, n: int, starts: np.ndarray, width: int, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
        seen: set[int] = set()
        for lo in range(0, len(starts), 4096):
            some = starts[lo : lo + 4096]
            held = hashes[some[:, None] + np.arange(width)]
            held = np.where(held == 0, np.arange(width, dtype=_U) * STEP + _U(12345), held)  # a word of no item matches none
            whole = grams(held.T, width)[0].tolist()
            new = np.array([w not in seen and not seen.add(w) for w in whole], bool)
            if new.any():
                yield n, some[new], width, grams(held[new].T, SHINGLE).T


def item_table(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_words, words, shingles, elements, print) of the items with a word; words, shingles and elements as hashes."""

    def make():
        memo = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = memo.of(text.lower().split())
                if len(hashes):
                    shingles = grams(hashes, SHINGLE)
                    rows.append((item, len(hashes), np.unique(hashes).view(np.int64), shingles.view(np.int64), elements(shingles[None, :])[0].view(np.int64), fingerprints(shingles[None, :])[0].view(np.int64)))
            if not rows:
                return None
            kinds = (pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 4)
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["item_id", "n_words", "words", "shingles", "elements", "print"])

        return step

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return arrow_map(items, make, "item_id long, n_words int, words array<long>, shingles array<long>, elements array<long>, print array<long>")


def bitmap(keys: DataFrame) -> bytes:
    """The bitmap of the column ``key``; not over 2 ** MOST_BITS bits come to the driver."""
    n = keys.agg(F.approx_count_distinct("key")).first()[0]
    bits = min(MOST_BITS, max(16, (BITS_A_KEY * n - 1).bit_length() if n else 0))
    at = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    placed = keys.select(F.shiftright(at, CHUNK_BITS.bit_length() - 1).alias("chunk"), at.bitwiseAND(F.lit(CHUNK_BITS - 1)).cast("int").alias("bit"))
    chunks = placed.groupBy("chunk").agg(F.collect_set("bit").alias("bits"))  # at most CHUNK_BITS of them

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for row in batch.column(1):
                flags = np.zeros(CHUNK_BITS, np.uint8)
                flags[row.values.to_numpy()] = 1
                out.append(np.packbits(flags, bitorder="little").tobytes())
            return pa.record_batch([batch.column(0), pa.array(out, "binary")], ["chunk", "bytes"])

        return step

    whole = bytearray((1 << bits) // 8)
    for r in arrow_map(chunks, make, "chunk long, bytes binary").toLocalIterator():
        whole[r.chunk * CHUNK_BITS // 8 : (r.chunk + 1) * CHUNK_BITS // 8] = r.bytes
    return bytes(whole)


def find_windows(docs: DataFrame, words: bytes, shingles: bytes, lengths: list[int]) -> DataFrame:
    """(row, doc_id, n, start, n_words, elements, print) from (row, doc_id, text); n is the word count of the items to look for."""
    names = ["row", "doc_id", "n", "start", "n_words", "elements", "print"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, held, size = Sieve(words, shingles, lengths), [[] for _ in names], 0

        def flush() -> pa.RecordBatch:
            counts = [len(x) for x in held[3]]
            many = lambda c: np.repeat(np.array(held[c], np.int64), counts)
            widths = np.repeat([x.shape[1] for x in held[5]], counts)
            offsets = np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)
            sets = pa.ListArray.from_arrays(offsets, np.concatenate([x.ravel() for x in held[5]]).view(np.int64))
            prints = np.concatenate(held[6]).view(np.int64)
            prints = pa.ListArray.from_arrays(np.arange(0, prints.size + 1, _LONGS, dtype=np.int32), prints.ravel())
            ids = pa.array([i for i, n in zip(held[1], counts, strict=True) for _ in range(n)], "int64")
            columns = [pa.array(many(0)), ids, pa.array(many(2).astype(np.int32)), pa.array(np.concatenate(held[3]).astype(np.int32)), pa.array(many(4).astype(np.int32)), sets, prints]
            for c in held:
                c.clear()
            return pa.record_batch(columns, names)

        for batch in batches:
            rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, texts in pieces(batch.column(2)):
                for i, text in enumerate(texts, first):
                    for n, starts, width, found in sieve.windows(text):
                        for c, v in zip(held, (rows[i], ids[i], n, starts, width, elements(found), fingerprints(found)), strict=True):
                            c.append(v)
                        size += found.size
                        if size > 500_000:
                            yield flush()
                            size = 0
        if size:
            yield flush()
        del sieve
        give_back()

    bound_batches(docs.sparkSession)
    return by_bytes(docs.select("row", "doc_id", "text")).mapInArrow(run, "row long, doc_id long, n int, start int, n_words int, elements array<long>, print array<long>")


class Index:
    """Items of one length, by the blocks of their fingerprints."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        values = np.arange(1 << BLOCK_BITS, dtype=np.uint8)
        blocks = prints.view(np.uint8).reshape(len(prints), -1)
        reach = RADIUS // blocks.shape[1]
        #: for each 64 items, block and value of the block: a bit for each item within reach of the value
        self.tables = np.zeros((-(-len(prints) // 64), blocks.shape[1], len(values)), _U)
        for lo in range(0, len(blocks), 64):
            near = np.bitwise_count(values ^ blocks[lo : lo + 64, :, None]) <= reach
            self.tables[lo // 64] = (near.astype(_U) << np.arange(len(near), dtype=_U)[:, None, None]).sum(axis=0, dtype=_U)

    def near(self, prints: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) within the radius."""
        out: list[tuple[int, int]] = []
        mine = prints.view(np.uint8).reshape(len(prints), -1)
        for chunk, table in enumerate(self.tables):
            some = np.bitwise_or.reduce(table[np.arange(mine.shape[1])[None, :], mine], axis=1)
            for k in range(chunk * 64, min(len(self.prints), chunk * 64 + 64)):
                w = np.flatnonzero(some & _U(1 << k % 64))
                far = np.bitwise_count(prints[w] ^ self.prints[k]).sum(axis=1)
                out += [(int(x), k) for x in w[far <= RADIUS]]
        return out


def rarest(rows: DataFrame, name: str, common: DataFrame, most: Column) -> DataFrame:
    """(name, n, e) of (name, n, elements): the first ``most`` elements, in order of how many items of n words have them; those of no item come first, and are left out then."""
    each = rows.select(name, "n", most.cast("int").alias("most"), F.explode("elements").alias("e")).join(common, ["n", "e"], "left")
    listed = each.groupBy(name, "n", "most").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("items", F.lit(0)).alias("items"), "e"))).alias("es"))  # as many as shingles
    return listed.select(name, "n", F.explode(F.slice("es", 1, F.col("most"))).alias("x")).where("x.items > 0").select(name, "n", "x.e")


def dealt(windows: DataFrame, items: DataFrame, work: Workspace) -> DataFrame:
    """Windows (w_row) and items (i_row) that share one of their rarest elements, in cells (n, e, i, w) of bounded size; role 0 are items, 1 windows.

    Elements that windows or items alone have are no cell.  Where more than a cell's fill share one, both sides are dealt to blocks by hash, and each block of one side meets each of the other.
    """
    items = items.withColumnRenamed("n_words", "n")
    least = lambda m, w: F.floor((PERCENT * (m + w) + 99 + PERCENT) / (100 + PERCENT))  # noqa: E731  in_common
    shingled = lambda c: F.greatest(F.lit(1), F.col(c) - SHINGLE + 1)
    m, w = shingled("n"), shingled("n_words")
    shortest = F.floor((PERCENT * m + 99) / 100)  # a text of fewer shingles matches no item of m
    common = work.settle(items.select("n", F.explode("elements").alias("e")).groupBy("n", "e").agg(F.count("*").alias("items")), "common")
    of_windows = work.settle(rarest(windows, "w_row", common, w - least(m, w) + 1), "of_windows")
    of_items = work.settle(rarest(items, "i_row", common, m - least(m, shortest) + 1), "of_items")
    fill = lambda d, most, name: d.groupBy("n", "e").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    cells = work.settle(fill(of_windows, WINDOWS, "n_w").join(fill(of_items, ITEMS, "n_i"), ["n", "e"]), "cells")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    none = F.lit(None).cast("long")
    left = of_items.join(cells, ["n", "e"]).select("n", "e", mine("i_row", "n_i").alias("i"), every("n_w").alias("w"), "i_row").join(items.select("i_row", "print"), "i_row")
    right = of_windows.join(cells, ["n", "e"]).select("n", "e", every("n_i").alias("i"), mine("w_row", "n_w").alias("w"), "w_row").join(windows.select("w_row", "print"), "w_row")
    return left.select("n", "e", "i", "w", F.lit(0).alias("role"), F.col("i_row").alias("id"), "print").union(right.select("n", "e", "i", "w", F.lit(1).alias("role"), "w_row", "print"))


def candidates(cells: DataFrame) -> DataFrame:
    """(w_row, i_row) of the windows and items of a cell whose SimHashes are within the radius; a pair that meets in several cells comes as often."""

    def step(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        n = int((rows.column("role").to_numpy() == 0).sum())
        if not 0 < n < rows.num_rows:
            return None
        prints, ids = rows.column("print").flatten().to_numpy().view(_U).reshape(-1, _LONGS), rows.column("id").to_numpy()
        index, found = Index(prints[:n]), []
        for lo in range(n, rows.num_rows, 4096):
            found += [(lo + x, k) for x, k in index.near(prints[lo : lo + 4096])]
        if not found:
            return None
        w, k = np.array(found, np.int64).T
        return pa.record_batch([pa.array(ids[w]), pa.array(ids[k])], ["w_row", "i_row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, 4):
            out = step(rows)
            if out is not None:
                yield out
        give_back()

    bound_batches(cells.sparkSession)
    return cells.repartition("n", "e", "i", "w").sortWithinPartitions("n", "e", "i", "w", "role").mapInArrow(run, "w_row long, i_row long")


def verified(pairs: DataFrame, windows: DataFrame, items: DataFrame) -> DataFrame:
    """(row, doc_id, item_id, start, n_words, similarity) of the pairs at the threshold or above, by all their shingles."""
    mine, theirs = windows.select("w_row", "row", "doc_id", "start", "n_words", F.col("elements").alias("ours")), items.select("i_row", "item_id", F.col("elements").alias("theirs"))
    met = pairs.join(mine, "w_row").join(theirs, "i_row").withColumn("both", F.size(F.array_intersect("ours", "theirs")))
    either = F.size("ours") + F.size("theirs") - F.col("both")
    return met.where(100 * F.col("both") >= PERCENT * either).select("row", "doc_id", "item_id", "start", "n_words", (F.col("both") / either).alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): each item that a text holds, at its best window, the first of equals.

    Words are runs without ASCII white space, A-Z lower-cased.  Items with fewer than 5 words have the whole sequence as one shingle;
    null or empty items and texts match nothing, and so it is with empty tables.  A text shorter than an item is compared with it as a whole.  Items of equal text match alike, each
    under its own id; items with a null id are left out.  A row in gives its own matches, its id repeated or null.
    An item that many texts hold, or a text that many items have, costs no task more than another: windows and items of a cell are dealt by hash.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "decontamination")
    items = work.settle(item_table(benchmark).withColumn("i_row", F.monotonically_increasing_id()), "items")
    lengths = [r.n_words for r in items.select("n_words").distinct().collect()]  # not more than the longest item has words
    if not lengths:
        return spark.createDataFrame([], "doc_id long, item_id long, start_word long, n_words long, similarity double")
    words = bitmap(items.select(F.explode("words").alias("key")))
    shingles = bitmap(_shingle_keys(items))
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    windows = work.settle(find_windows(docs, words, shingles, lengths).withColumn("w_row", F.monotonically_increasing_id()), "windows")
    pairs = work.settle(candidates(dealt(windows, items, work)).distinct(), "pairs")
    found = verified(pairs, windows, items)
    best = found.groupBy("row", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("late"), "n_words", "doc_id")).alias("b"))
    return best.select("b.doc_id", "item_id", (-F.col("b.late")).cast("long").alias("start_word"), F.col("b.n_words").cast("long").alias("n_words"), "b.similarity")


def _shingle_keys(items: DataFrame) -> DataFrame:
    """(key) of all shingles: for items of their length, and, from SHINGLE words on, for any."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = []
            for n, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = row.values.to_numpy().view(_U)
                keys += [of_length(values, k) for k in ({n, 0} if n >= SHINGLE else {n})]
            return pa.record_batch([pa.array(np.concatenate(keys).view(np.int64))], ["key"])

        return step

    return arrow_map(items.select("n_words", "shingles"), make, "key long")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; rows with a null id go if the text of any of them holds one.

    Rows of one id go together.  Null and empty texts hold nothing and stay.
    """
    # a written table, whose size is known: a small one spares the documents a shuffle
    hit = Workspace(docs.sparkSession, "hit").settle(contaminated(docs, benchmark).select("doc_id").distinct(), "hit")
    name = fresh(docs, "_hit")
    return docs.join(hit.withColumnRenamed("doc_id", name), docs.doc_id.eqNullSafe(F.col(name)), "left_anti")

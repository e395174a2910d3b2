"""Near duplicates by banded MinHash, odd sketches and exact Jaccard similarity of word shingles.

1. One pass over the texts: each document's set of shingle hashes gives ``bands`` x ``rows`` MinHash values. They are
   folded into band keys, and into an odd sketch: a bitmap in which each pair (hash function, value) flips one bit.
   The XOR of two sketches is the sketch of the symmetric difference of their samples, and from its population
   count the similarity is estimated best just where it is high.
2. Documents of equal sets are one class, its smallest id its representative.
3. In each bucket every member is paired with the smallest one, the hub (a star, not all pairs).  Sketches drop what lies
   far below the threshold (by more than five standard deviations), full sets confirm the rest.
4. Components of the confirmed links.  Two documents that share a bucket share its hub; so the strangers of a star, which are not in its hub's
   component, still have to meet its other members.  They do so in cells of bounded size, first by sketches alone; full sets
   are fetched only for what is near a member of another component.
5. Components over all links, and the classes' members after them.

A pair at the threshold shares no bucket with probability (1 - 0.8^rows)^bands, 6e-7 by default.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.llm.common import Workspace, arrow_map, bound_batches, by_bytes, give_back, pieces, runs_of
from heronry.llm.components import connected_components
from heronry.llm.words import STEP, WordHashes, grams, mixed

ROWS, BANDS, SKETCH_BITS = 5, 36, 512
#: Rows and bytes of a block of full sets, rows of a block that meets one hub, and of a block of sketches.
BLOCK, BLOCK_BYTES, HUB_BLOCK, SKETCH_BLOCK = 256, 4_000_000, 128, 256
_U = np.uint64
_SEEDS = mixed(np.arange(1, ROWS * BANDS + 1, dtype=_U) * STEP) | _U(1)
_WORDS = SKETCH_BITS // 64


def shingle_sets(texts: list[bytes], n: int, memo: WordHashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return [np.unique(grams(memo.of(t.lower().split()), n)) for t in texts]


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketches) of non-empty sets."""
    k = ROWS * BANDS
    values = np.empty((len(sets), k), _U)
    lo = 0
    while lo < len(sets):
        hi, total = lo, 0
        while hi < len(sets) and (hi == lo or total + len(sets[hi]) <= 16_384):  # stays in the cache
            total, hi = total + len(sets[hi]), hi + 1
        flat = np.concatenate(sets[lo:hi])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[lo : hi - 1]], dtype=np.int64)]).astype(np.int64)
        for j in range(k):
            values[lo:hi, j] = np.minimum.reduceat(flat * _SEEDS[j], starts)
        lo = hi
    keys = np.zeros((len(sets), BANDS), _U) + np.arange(1, BANDS + 1, dtype=_U)
    for r in range(ROWS):
        keys = mixed(keys * STEP + values[:, r::ROWS])
    bits = (mixed(values + np.arange(k, dtype=_U) * STEP) % _U(SKETCH_BITS)).astype(np.int64)
    odd = np.zeros((len(sets), SKETCH_BITS), np.uint8)
    np.add.at(odd, (np.repeat(np.arange(len(sets)), k), bits.ravel()), 1)
    return keys.view(np.int64), np.packbits(odd & 1, axis=1, bitorder="little").view(_U)


def estimate(flips: np.ndarray | int) -> np.ndarray:
    """Similarity from the population count of the XOR of two odd sketches."""
    share = np.minimum(2 * np.asarray(flips) / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / (4 * ROWS * BANDS) * np.log1p(-share)


def most_flips(percent: int) -> int:
    """Population counts above this are over five standard deviations from a pair at the threshold."""
    k, d = ROWS * BANDS, 1 - percent / 100
    apart = k * d + 5 * np.sqrt(k * d * (1 - d))  # samples that differ; each flips two bits, some of them back
    mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * apart))
    return int(np.ceil(mean + 2 * np.sqrt(mean)))


def sketch_documents(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, sketch); bands and sketch are null for an empty set."""

    def make():
        memo = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, digests, bands, sketches = [], [], [], []
            for _, texts in pieces(batch.column(1)):
                sets = shingle_sets(texts, n, memo)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, odd = signatures([sets[i] for i in full]) if full else ([], [])
                found = {i: (k, o) for i, k, o in zip(full, keys, odd, strict=True)}
                for i, s in enumerate(sets):
                    sizes.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(found[i][0] if i in found else None)
                    sketches.append(found[i][1].view(np.int64) if i in found else None)
            return pa.record_batch([batch.column(0), pa.array(sizes, "int64"), pa.array(digests, "binary"), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands", "sketch"])

        return step

    return arrow_map(by_bytes(docs.select("doc_id", "text")), make, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>")


def flips_between(a: Column, b: Column) -> Column:
    """The population count of the XOR of two sketches."""
    return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(1, _WORDS)), F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, sketch, full): full holds the sorted distinct shingle hashes as bytes."""

    def make():
        memo = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            full: list[bytes] = []
            for _, texts in pieces(batch.column(1)):
                full += [s.tobytes() for s in shingle_sets(texts, n, memo)]
            return pa.record_batch([batch.column(0), batch.column(2), pa.array(full, "binary")], ["id", "sketch", "full"])

        return step

    return arrow_map(by_bytes(docs.select("id", "text", "sketch")), make, "id long, sketch array<long>, full binary")


def dealt(members: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Members of stars, (hub, id, part, stranger, n_bytes, ...), dealt into cells (hub, i, j) so that each stranger meets each member.

    Strangers (what is not in the hub's component) are cut into blocks i, all members into blocks j, by hash; a stranger is in its row of cells with role
    0, a member in its column of cells with role 1, or 2 if it is a stranger itself.  A block has about so many rows and bytes at most, so
    a star with few strangers is read about once, and no cell grows with its star.
    """
    mine = lambda what: F.sum(F.when(F.col("stranger"), what).otherwise(0))
    blocks = lambda rows, size: F.greatest(F.lit(1), F.ceil(rows / most_rows), F.ceil(size / most_bytes)).cast("int")
    stars = members.groupBy("hub").agg(blocks(mine(F.lit(1)), mine(F.col("n_bytes"))).alias("n_i"), blocks(F.count("*"), F.sum("n_bytes")).alias("n_j"))
    placed = members.join(stars, "hub").withColumns({"own_i": F.pmod(F.xxhash64("id", F.lit(1)), F.col("n_i")).cast("int"), "own_j": F.pmod(F.xxhash64("id", F.lit(2)), F.col("n_j")).cast("int")})
    cell = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.cast("int").alias("role"))
    row = F.transform(F.sequence(F.lit(0), F.col("n_j") - 1), lambda j: cell(F.col("own_i"), j, F.lit(0)))
    column = F.transform(F.sequence(F.lit(0), F.col("n_i") - 1), lambda i: cell(i, F.col("own_j"), F.when(F.col("stranger"), 2).otherwise(1)))
    exploded = placed.withColumn("cell", F.explode(F.when(F.col("stranger"), F.concat(row, column)).otherwise(column)))
    rest = [c for c in members.columns if c not in ("hub", "stranger", "n_bytes")]
    return exploded.select("hub", "cell.i", "cell.j", "cell.role", *rest)


def _sketches(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().view(_U).reshape(-1, _WORDS)


def _by_cell(cells: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``step`` for each cell, its rows in order of role and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, 3):
            out = step(rows)
            if out is not None and out.num_rows:
                yield out
        give_back()

    bound_batches(cells.sparkSession)
    return cells.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "role", "id").mapInArrow(run, schema)


def near_any(cells: DataFrame, percent: int) -> DataFrame:
    """(hub, id) of members of which the sketch is near that of a member of another part, from cells of (hub, i, j, role, id, part, sketch)."""
    most = most_flips(percent)

    def step(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        role, ids, part = (rows.column(n).to_numpy() for n in ("role", "id", "part"))
        sketches, n = _sketches(rows.column("sketch")), int((role == 0).sum())
        alive = np.zeros(len(ids), bool)
        for x in range(n):
            some = n + np.flatnonzero((part[n:] != part[x]) & ((role[n:] == 1) | (ids[n:] > ids[x])))
            near = some[np.bitwise_count(sketches[some] ^ sketches[x]).sum(axis=1) <= most]
            alive[near] = True
            alive[x] |= len(near) > 0
        return pa.record_batch([rows.column("hub").filter(pa.array(alive)), pa.array(ids[alive], "int64")], ["hub", "id"])

    return _by_cell(cells.select("hub", "i", "j", "role", "id", "part", "sketch"), step, "hub long, id long")


def cell_links(role: np.ndarray, ids: np.ndarray, parts: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of role 0, which come first, and others of other parts; a spanning set of them.

    Sketches say which to look at; intersections are counted over an index of the others' shingles.
    """
    most, out, n = most_flips(percent), [], int((role == 0).sum())
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets[n:]) if n < len(sets) else np.zeros(0, _U)
    order = np.argsort(flat, kind="stable")
    posts, flat = np.repeat(np.arange(n, len(sets)), sizes[n:])[order], flat[order]
    merged = parts.copy()
    for x in range(n):
        some = (merged[n:] != merged[x]) & ((role[n:] != 2) | (ids[n:] > ids[x]))
        if not some.any():
            continue
        some = n + np.flatnonzero(some)
        some = some[np.bitwise_count(sketches[some] ^ sketches[x]).sum(axis=1) <= most]
        if not len(some):
            continue
        lo, hi = np.searchsorted(flat, sets[x]), np.searchsorted(flat, sets[x], "right")
        held = np.flatnonzero(hi > lo)
        lo, count = lo[held], (hi - lo)[held]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(held) else held
        common = np.bincount(posts[at], minlength=len(ids))[some]
        for y in some[100 * common >= percent * (sizes[some] + sizes[x] - common)].tolist():
            if merged[y] != merged[x]:
                out.append((int(ids[x]), int(ids[y])))
                merged[merged == merged[y]] = merged[x]
    return out


def links_in(cells: DataFrame, percent: int) -> DataFrame:
    """(a, b) links between different parts, from cells of (hub, i, j, role, id, part, sketch, full)."""

    def step(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        role, ids, part = (rows.column(n).to_numpy() for n in ("role", "id", "part"))
        sets = [np.frombuffer(b.as_buffer(), _U) for b in rows.column("full")]
        found = cell_links(role, ids, part, _sketches(rows.column("sketch")), sets, percent)
        return pa.record_batch([pa.array([x[k] for x in found], "int64") for k in (0, 1)], ["a", "b"])

    return _by_cell(cells.select("hub", "i", "j", "role", "id", "part", "sketch", "full"), step, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of (doc_id, text).

    Links join documents whose sets of n-word shingles have 100 * intersection >= percent * union; component_id is
    the smallest doc_id reachable, and kept marks the row whose own id that is.  Words are runs without ASCII white space,
    A-Z lower-cased; with fewer than n words the whole sequence is the one shingle.  A null or empty text, or one of white
    space, has no shingle and is linked with nothing.  Rows with a null id are linked with nothing either, and
    are kept.  doc_id is taken as unique: of rows that repeat an id, the texts count as one document's each, and all
    get the one id's component.  Shingles are compared by 64-bit hashes.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "near")
    most = most_flips(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = work.settle(sketch_documents(docs, n), "signed")
    known = signed.where("doc_id is not null and n_shingles > 0")
    classes = work.settle(known.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    # merge joins at every size: the plan, and what it shuffles, then grows as the input does
    heads = known.join(classes.hint("merge"), (known.set_key == classes.set_key) & (known.doc_id == classes.rep)).select(known.doc_id.alias("id"), known.set_key, "n_shingles", "bands", "sketch")
    heads = work.settle(heads.dropDuplicates(["id", "set_key"]).drop("set_key"), "heads")

    keyed = heads.select("id", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    stars = work.settle(keyed.join(hubs.hint("merge"), "key").where("id <> hub").select("hub", "id").distinct(), "stars", few=True)
    sketches = heads.select("id", (8 * F.col("n_shingles")).alias("n_bytes"), "sketch")
    hub_sketches = heads.select(F.col("id").alias("hub"), F.col("sketch").alias("hub_sketch"))
    met = stars.join(sketches.hint("merge"), "id").join(hub_sketches.hint("merge"), "hub")
    met = work.settle(met.select("hub", "id", "n_bytes", (flips_between(F.col("hub_sketch"), F.col("sketch")) <= most).alias("near")), "met", few=True)

    def sets_of(ids: DataFrame, name: str, *hint: str) -> DataFrame:
        ids = work.settle(ids.distinct(), f"{name}_ids", few=True)
        for h in hint:
            ids = ids.hint(h)
        sketched = heads.select("id", "sketch").join(ids, "id")
        texts = docs.withColumnRenamed("doc_id", "id").join(ids, "id")
        return work.settle(full_sets(texts.join(sketched, "id"), n), name, "none")

    # a star's hub is its one stranger: it meets the members whose sketch is near its own
    pairs = met.where("near").select("hub", "id", F.col("id").alias("part"), F.lit(False).alias("stranger"), "n_bytes")
    centres = pairs.select("hub").distinct().select("hub", F.col("hub").alias("id"), F.col("hub").alias("part"), F.lit(True).alias("stranger"), F.lit(0).cast("long").alias("n_bytes"))
    sets = sets_of(pairs.select("id").union(centres.select("id")), "sets", "merge")
    cells = dealt(pairs.union(centres), HUB_BLOCK, BLOCK_BYTES).where("role <> 2").join(sets.hint("merge"), "id")
    direct = work.settle(links_in(cells, percent), "direct", few=True)
    parts = connected_components(direct)

    part_of = lambda df, key, name: df.join(parts.select(F.col("id").alias(key), "component"), key, "left").withColumn(name, F.coalesce("component", key)).drop("component")
    placed = part_of(part_of(met.drop("near"), "id", "part"), "hub", "hub_part").withColumn("stranger", F.col("part") != F.col("hub_part"))
    placed = work.settle(placed.drop("hub_part"), "placed", few=True)
    unsettled = placed.groupBy("hub").agg(F.max("stranger").alias("open"), F.min("part").alias("p0"), F.max("part").alias("p1")).where("open and p0 < p1").select("hub")
    members = work.settle(placed.join(unsettled, "hub"), "members", few=True)
    light = dealt(members.withColumn("n_bytes", F.lit(8 * _WORDS)), SKETCH_BLOCK, BLOCK_BYTES).join(sketches.drop("n_bytes").hint("merge"), "id")
    alive = work.settle(near_any(light, percent).distinct(), "alive", few=True)
    rest = work.settle(members.join(alive.hint("merge"), ["hub", "id"]), "rest", few=True)
    # few ids, most often: without a hint their written size decides whether the texts are shuffled for them
    more = links_in(dealt(rest, BLOCK, BLOCK_BYTES).join(sets_of(rest.select("id"), "more_sets").hint("merge"), "id"), percent)
    more = work.settle(more, "more", few=True)
    whole = parts if more.isEmpty() else connected_components(direct.union(more))
    final = classes.join(whole.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    own = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("set_key")).alias("set_key"))
    out = own.join(final, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    work.drop("heads", "stars", "met", "sets_ids", "sets", "direct", "placed", "members", "alive", "rest", "more_sets_ids", "more_sets", "more")
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def sql(n: int, percent: int) -> str:
    """DuckDB SQL of the same result from all pairs of documents with a shingle in common: for small tables."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {n - 1}], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {percent} * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.y, r.c FROM reach r JOIN b ON b.x = r.id WHERE r.c < b.y)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM reach GROUP BY 1) m ON m.id = d.doc_id"""

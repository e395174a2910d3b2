"""A trie of conversations by prefix-doubling naming.

1. Turns are numbered in order, and each distinct (role, text) gets a dense name: a number below that of distinct values.
2. Doubling: a block of 2**k turns that starts at a multiple of 2**k is the pair of its halves' names, and each distinct pair gets a dense
   name.  That is a join round a power of two; blocks of all sizes are less than twice the turns.
3. Composition: the first d turns are the blocks of d's binary digits, largest first.  The name of a prefix is that of the prefix without the
   lowest digit and the last block, again named densely; a round joins the prefixes of one digit more.
4. Equal (d, name) are a node.  Its id is its smallest conversation with d.
5. Sums over subtrees: the nodes of one smallest conversation are a chain down the trie.  Chains hang on nodes of chains of smaller conversations; their
   totals are summed up in pointer-doubling rounds, and within a chain by a running sum from its end.

Rounds grow as the logarithm of the longest conversation and of the deepest nesting of chains.  No conversation, node or name is gathered
in one task: rows are joined by (conversation, place), groups are pre-aggregated, one long conversation is numbered and summed in ranges, and
joins on a common name have a row a name on the other side, so that AQE can split them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm.common import Workspace, bound_batches
from heronry.operators.ranges import Ranges, numbered

#: So many ids at most are one piece of a list of members.
PIECE_BITS = 12


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, letter, n_bytes): turns numbered from 0 by turn, null first, then by a hash of role and text, which is ``letter``.

    Null roles and texts are empty; rows without a conv_id are left out; repeated rows are turns of their own.  ``letter`` is the SHA-256 of role and text, n_bytes the text's
    UTF-8 length.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    letter = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", letter.alias("letter"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = Workspace(conversations.sparkSession, "turns").settle(rows, "turns")
    return numbered(rows, ["conv_id"], ["turn", "letter"], "pos").select("conv_id", "pos", "letter", "n_bytes")


def rebuilt(turns: DataFrame, base: Column, shared: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as another: the first ``shared`` turns of ``base`` (both of conv_id), then their own after their first ``shared``.

    Returns the turns and the conversations (conv_id), among them those that are left without turns.  A base that isn't there gives none.
    """
    work = Workspace(turns.sparkSession, "rebuilt")
    turns = work.settle(turns, "turns")
    counts = work.settle(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "counts")
    convs = counts.select("conv_id", base.cast("long").alias("base"), shared.cast("long").alias("shared"))
    lent = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("lent"))
    convs = work.settle(convs.join(lent, "base", "left").withColumn("lent", F.least("shared", F.coalesce("lent", F.lit(0)))), "convs")
    first = turns.withColumnRenamed("conv_id", "base").join(convs.where("lent > 0"), "base").where("pos < lent").select("conv_id", "pos", "letter", "n_bytes")
    own = turns.join(convs, "conv_id").where("pos >= shared").select("conv_id", (F.col("pos") - F.col("shared") + F.col("lent")).alias("pos"), "letter", "n_bytes")
    return first.union(own), convs.select("conv_id")


def dense_names(work: Workspace, rows: DataFrame, columns: list[str], tag: str) -> DataFrame:
    """(columns, name): the distinct values, numbered from 0 without gaps."""
    low = (1 << 33) - 1  # Spark's ids have the place within the task in their low 33 bits
    once = rows.select(*columns).distinct().select(*columns, F.monotonically_increasing_id().alias("at"))
    once = work.settle(once.select(*columns, F.shiftright("at", 33).alias("task"), F.col("at").bitwiseAND(F.lit(low)).alias("at")), tag)
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = once.groupBy("task").count().select("task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))  # a row a task, and so small enough to broadcast
    return once.join(F.broadcast(offsets), "task").select(*columns, (F.col("at") + F.col("offset")).alias("name"))


def _named(work: Workspace, rows: DataFrame, columns: list[str], tag: str) -> DataFrame:
    rows = work.settle(rows, f"{tag}_pairs")
    out = work.settle(rows.join(dense_names(work, rows, columns, f"{tag}_names"), columns).drop(*columns), tag)
    work.drop(f"{tag}_pairs", f"{tag}_names")
    return out


def prefixes(work: Workspace, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, name) of each conversation's first turns, from depth 1 on; prefixes are equal where depth and name are."""
    letters = dense_names(work, turns, ["letter"], "letters")
    level = work.settle(turns.join(letters, "letter").select("conv_id", F.col("pos").alias("idx"), "name"), "level0")
    longest = level.agg(F.max("idx")).first()[0]
    if longest is None:
        return level.select("conv_id", F.col("idx").alias("depth"), "name")
    levels = [level]
    for k in range(1, int(longest + 1).bit_length()):
        half = lambda odd: F.max(F.when(F.col("idx") % 2 == odd, F.col("name")))
        pairs = levels[-1].groupBy("conv_id", F.shiftright("idx", 1).alias("next")).agg(half(0).alias("a"), half(1).alias("b")).where("b is not null")
        levels.append(_named(work, pairs, ["a", "b"], f"level{k}").withColumnRenamed("next", "idx"))
    # a block at an even place ends one prefix; its other blocks are the digits of its place
    ends = reduce(DataFrame.union, (b.where("idx % 2 = 0").select("conv_id", F.shiftleft("idx", k).alias("before"), F.shiftleft(F.col("idx") + 1, k).alias("depth"), F.col("name").alias("last"), F.bit_count("idx").alias("digits")) for k, b in enumerate(levels)))
    ends = work.settle(ends, "ends")
    known = [ends.where("digits = 0").select("conv_id", "depth", F.col("last").alias("name"))]
    for digits in range(1, int(longest + 1).bit_length()):
        earlier = known[-1].select("conv_id", F.col("depth").alias("before"), F.col("name").alias("first"))
        pairs = ends.where(F.col("digits") == digits).join(earlier, ["conv_id", "before"]).select("conv_id", "depth", F.col("depth").alias("d"), "first", "last")
        known.append(_named(work, pairs, ["d", "first", "last"], f"prefix{digits}"))
    return reduce(DataFrame.union, known)


def member_hashes(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ends_sha256) of (keys, conv_id): the hash of the ids in order, joined by commas.

    Ids are joined in pieces first; a hash has to be told its bytes in order, so a node's pieces pass through one task, one at a time.
    """
    piece = members.groupBy(*keys, F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == last:
                    state.update(b",")
                else:
                    if last is not None:
                        done.append((*last, state.hexdigest()))
                    last, state = key, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.record_batch([pa.array(c) for c in zip(*done, strict=True)], [*keys, "ends_sha256"])
        if last is not None:
            yield pa.record_batch([pa.array([c]) for c in (*last, state.hexdigest())], [*keys, "ends_sha256"])

    bound_batches(members.sparkSession)
    return piece.repartition(*keys).sortWithinPartitions(*keys, "piece").select(*keys, "ids").mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", ends_sha256 string")


def chain_totals(work: Workspace, chains: DataFrame, sums: list[str]) -> DataFrame:
    """(chain, sums): each chain's own sums and those of all chains that hang on it, however far down, from (chain, up, sums); up is null at the top.

    After round k a chain has the sums of those less than 2**k steps below, and knows the chain 2**k steps above.
    """
    state, k = work.settle(chains, "chains0"), 0
    while not state.where("up is not null").isEmpty():
        below = state.where("up is not null").groupBy(F.col("up").alias("chain")).agg(*(F.sum(c).alias(f"_{c}") for c in sums))
        higher = state.where("up is not null").select(F.col("chain").alias("up"), F.col("up").alias("_up"))
        new = state.join(below, "chain", "left").join(higher, "up", "left")
        k += 1
        state = work.settle(new.select("chain", F.col("_up").alias("up"), *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums)), f"chains{k}")
        work.drop(f"chains{k - 1}")
    return state.select("chain", *sums)


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row a node of the trie of all conversations' turns, from (conv_id, pos, letter, n_bytes) and the distinct (conv_id), those without turns too.

    conv_id (the node's smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (nodes without children in the subtree),
    saved_tokens (over the subtree, the bytes of a node's last text for each member but one), ends_sha256 (of the members that end here).
    Without conversations there is no node; conversations without turns end at the root.
    """
    spark = turns.sparkSession
    work = Workspace(spark, "trie")
    turns, convs = work.settle(turns, "given"), work.settle(conversations.select("conv_id"), "convs")
    found = work.settle(prefixes(work, turns), "prefixes")
    grouped = found.groupBy("depth", "name").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nodes = work.settle(grouped.unionByName(top.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), "conv_id", "n_convs")), "grouped")

    # the node above: that of the same conversation's prefix without the last turn
    step = found.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name")))
    above = step.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("up_name"))
    owner = nodes.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("up_name"), F.col("conv_id").alias("parent_conv_id"))
    last = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "n_bytes")
    nodes = nodes.join(above, ["conv_id", "depth"], "left").join(owner, ["depth", "up_name"], "left").join(last, ["conv_id", "depth"], "left").drop("up_name")
    nodes = work.settle(nodes, "nodes")

    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    lengths = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("depth"))
    ended = found.join(lengths, ["conv_id", "depth"]).select("depth", "name", "conv_id")
    turnless = convs.join(lengths, "conv_id", "left_anti").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), "conv_id")
    hashes = member_hashes(ended.union(turnless), ["depth", "name"])
    weighed = nodes.join(children, ["conv_id", "depth"], "left").join(hashes, ["depth", "name"], "left")
    leaf, saved = F.col("n_children").isNull().cast("long"), (F.col("n_convs") - 1) * F.coalesce("n_bytes", F.lit(0))
    weighed = work.settle(weighed.withColumns({"leaves": leaf, "saved": saved}).drop("name", "n_bytes"), "weighed")

    hung = F.col("parent_conv_id").isNull() | (F.col("parent_conv_id") != F.col("conv_id"))  # a chain's uppermost node
    chains = weighed.groupBy(F.col("conv_id").alias("chain")).agg(F.max(F.when(hung, F.col("parent_conv_id"))).alias("up"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    totals = chain_totals(work, chains, ["leaves", "saved"]).withColumnRenamed("chain", "conv_id")
    hangs = weighed.where(hung & F.col("parent_conv_id").isNotNull()).select("conv_id", "parent_conv_id", "depth").join(totals, "conv_id")
    more = hangs.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    full = weighed.join(more, ["conv_id", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}).withColumn("_from_end", -F.col("depth"))
    full = work.settle(full, "full")
    ranges = Ranges(full, ["conv_id"], ["_from_end"])
    rows = ranges.with_carried(ranges.rows, [F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved")], {"_b_leaves": F.sum("_leaves"), "_b_saved": F.sum("_saved")})
    running = lambda c: F.sum(c).over(ranges.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.coalesce(f"_b_{c}", F.lit(0))
    none = hashlib.sha256(b"").hexdigest()
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), running("leaves").alias("n_leaves"), running("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame, group: int = 5, modulus: int = 9) -> DataFrame:
    """The trie of conversations c that begin with the first h turns of c - c % group, h = crc32(decimal c) % modulus; see ``rebuilt`` and ``prefix_trie``.

    Columns beyond conv_id, turn, role and text are of no account, whatever their names.
    """
    c = F.col("conv_id")
    turns, convs = rebuilt(ordered_turns(conversations), c - c % group, F.crc32(c.cast("string").cast("binary")) % modulus)
    return prefix_trie(turns, convs)


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, b:
 list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
#: The same rows by lists of turns; nodes meet all their ancestors, so it is for small tables.
SQL = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, c - c % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
n AS (SELECT k.*, least(h, coalesce(m, 0)) AS lent FROM k LEFT JOIN (SELECT c AS base, count(*) AS m FROM t GROUP BY 1) USING (base)),
r AS (SELECT n.c, t.pos, role, text FROM n JOIN t ON t.c = n.base AND t.pos < n.lent
 UNION ALL SELECT n.c, t.pos - h + lent, role, text FROM n JOIN t ON t.c = n.c AND t.pos >= h),
p AS (SELECT c, pos + 1 AS depth, list({{'r': role, 't': text}}) OVER (PARTITION BY c ORDER BY pos) AS seq, strlen(text) AS bytes, pos = max(pos) OVER (PARTITION BY c) AS ends FROM r
 UNION ALL SELECT c, 0, [], 0, c NOT IN (SELECT c FROM r) FROM k),
g AS (SELECT depth, seq, min(c) AS m, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
o AS (SELECT p.c, p.depth, g.m FROM p JOIN g USING (depth, seq)),
f AS (SELECT g.*, o.m AS up FROM g LEFT JOIN o ON o.c = g.m AND o.depth = g.depth - 1),
w AS (SELECT f.*, coalesce(n, 0) AS n_children FROM f LEFT JOIN (SELECT up AS m, depth - 1 AS depth, count(*) AS n FROM f WHERE depth > 0 GROUP BY 1, 2) USING (m, depth)),
s AS (SELECT o.m, o.depth, sum((w.n_children = 0)::INT) AS n_leaves, sum((w.n_convs - 1) * w.bytes) AS saved FROM w JOIN o ON o.c = w.m AND o.depth <= w.depth GROUP BY 1, 2)
SELECT m AS conv_id, depth::BIGINT AS depth, up AS parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256 FROM w JOIN s USING (m, depth)"""

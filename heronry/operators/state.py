"""Keyed tables: upserts, updates, change detection, cursors over ordered numbers.

A table is a DataFrame; an operator returns the new state.  Merges are equi joins on the key, last write wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.urls import is_url
from heronry.operators.ranges import Ranges

#: The states, in order, and the cursors' roles.
WORKFLOW = ("unknown", "processing", "spider:begun", "spider:success", "spider:fail", "extractor:begun", "extractor:success", "extractor:fail", "fields:selected", "fields:posted")
#: Which states may follow which.
TRANSITIONS = {
    "unknown": ("processing",),
    "processing": ("spider:begun",),
    "spider:begun": ("spider:success", "spider:fail", "extractor:begun", "extractor:success", "extractor:fail"),
    "spider:success": ("extractor:begun", "extractor:success", "extractor:fail"),
    "extractor:begun": ("extractor:success", "extractor:fail"),
    "extractor:success": ("fields:selected", "fields:posted"),
    "fields:selected": ("fields:posted",),
}
CURSOR_ROLES = ("fetch-notes", "extract-fields")


def last_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the one of greatest ``order``; found by pre-aggregation, so that a hot key costs no more than another."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in others if c != order])).alias("b"))
    return best.select(*keys, *(F.col(f"b.{c}").alias(c) for c in others))


def upsert(state: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace rows of equal key, column by column where they aren't null, and are added otherwise."""
    cols = [c for c in state.columns if c not in keys]
    s, c = state.alias("s"), changes.alias("c")
    joined = s.join(c, keys, "full_outer")
    return joined.select(*keys, *(F.coalesce(F.col(f"c.{x}"), F.col(f"s.{x}")).alias(x) if x in changes.columns else F.col(f"s.{x}").alias(x) for x in cols))


def update_only(state: DataFrame, changes: DataFrame, keys: list[str], unset: tuple[str, ...] = ()) -> DataFrame:
    """As ``upsert``, without new rows; columns in ``unset`` become null where the key has a change."""
    cols = [c for c in state.columns if c not in keys]
    joined = state.alias("s").join(changes.withColumn("_hit", F.lit(True)).alias("c"), keys, "left")
    new = lambda x: F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(f"s.{x}")) if x in unset else F.coalesce(F.col(f"c.{x}"), F.col(f"s.{x}")) if x in changes.columns else F.col(f"s.{x}")
    return joined.select(*keys, *(new(x).alias(x) for x in cols))


def update_if_changed(state: DataFrame, keys: list[str], **new: Column) -> DataFrame:
    """The rows that a read-modify-write changes, with their new values; rows that stay equal are left out."""
    d = state.withColumns({f"_new_{k}": v for k, v in new.items()})
    same = F.lit(True)
    for k in new:
        same = same & F.col(f"_new_{k}").eqNullSafe(F.col(k))
    return d.filter(~same).select(*keys, *(F.col(f"_new_{c}").alias(c) if c in new else F.col(c) for c in state.columns if c not in keys))


def delete_keys(state: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return state.join(gone.select(*keys).distinct(), keys, "left_anti")


def insert_if_absent(state: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key the state doesn't have: what a write-once sink appends."""
    return rows.join(state.select(*keys).distinct(), keys, "left_anti")


def lookup(state: DataFrame, key: str, value: object) -> DataFrame:
    return state.filter(F.col(key) == F.lit(value)).limit(1)


def note_status(notes: DataFrame) -> DataFrame:
    """(id, number, url, validUrl) from (id, number, url): an invalid address is kept as ``Invalid URL: ...``."""
    ok = is_url(F.col("url"))
    return notes.select("id", "number", F.when(ok, F.col("url")).otherwise(F.concat(F.lit("Invalid URL: "), F.coalesce("url", F.lit("undefined")))).alias("url"), ok.alias("validUrl"))


def url_status_of_note(notes: DataFrame) -> DataFrame:
    """(id, requestUrl, hasAbstract, hasPdfLink, workflowStatus) of notes with a valid address: success if abstract and link are there."""
    has_abs, has_pdf = F.col("abstract").isNotNull(), F.col("pdf").isNotNull()
    return notes.filter(is_url(F.col("url"))).select("id", F.col("url").alias("requestUrl"), has_abs.alias("hasAbstract"), has_pdf.alias("hasPdfLink"), F.when(has_abs & has_pdf, F.lit("extractor:success")).otherwise(F.lit("unknown")).alias("workflowStatus"))


def field_status(values: DataFrame) -> DataFrame:
    """(noteId, fieldType, contentHash) of the values that are there."""
    return values.filter("value is not null").select("noteId", "fieldType", F.sha1("value").alias("contentHash"))


def changed_fields(stored: DataFrame, values: DataFrame) -> DataFrame:
    """Values whose SHA-1 differs from the stored one, or that are new."""
    new = values.filter("value is not null").withColumn("contentHash", F.sha1("value"))
    old = stored.select("noteId", "fieldType", F.col("contentHash").alias("oldHash"))
    return new.join(old, ["noteId", "fieldType"], "left").filter(~F.col("contentHash").eqNullSafe(F.col("oldHash"))).drop("oldHash")


def next_valid(notes: DataFrame, after: int, k: int = 1) -> DataFrame:
    """The k-th note with a valid address whose number is above ``after``; no row if there are fewer."""
    return notes.filter((F.col("number") > after) & F.col("validUrl")).orderBy("number").offset(k - 1).limit(1)


def prev_valid(notes: DataFrame, before: int, k: int = 1) -> DataFrame:
    return notes.filter((F.col("number") < before) & F.col("validUrl")).orderBy(F.col("number").desc()).offset(k - 1).limit(1)


def seek_all(notes: DataFrame, positions: DataFrame) -> DataFrame:
    """(number, next, prev): for each position the nearest numbers with a valid address above and below it.

    Numbers are cut into ranges with about equally many rows; a window runs inside a range, and the ranges' own bounds, of which there is a row a range, carry
    over the edges.  So no window runs over all rows in one task, however numbers bunch up.
    """
    valid = notes.filter("validUrl").select("number").distinct()
    marks = valid.select("number", F.lit(True).alias("valid")).unionByName(positions.select("number", F.lit(False).alias("valid")))
    marks = Ranges(marks, [], ["number"], name="b", like=positions).rows.withColumn("v", F.when(F.col("valid"), F.col("number")))
    # running frames both ways: one that ends with the partition would be gone through anew for each row
    up = Window.partitionBy("b").orderBy(F.col("number").desc()).rangeBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("b").orderBy("number").rangeBetween(Window.unboundedPreceding, -1)
    local = marks.withColumn("next", F.min("v").over(up)).withColumn("prev", F.max("v").over(down)).filter("not valid")
    bounds = marks.groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    edge_up, edge_down = Window.orderBy("b").rowsBetween(1, Window.unboundedFollowing), Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    # a row a range: small enough for one task
    edges = bounds.select("b", F.min("lo").over(edge_up).alias("above"), F.max("hi").over(edge_down).alias("below"))
    return local.join(edges, "b").select("number", F.coalesce("next", "above").alias("next"), F.coalesce("prev", "below").alias("prev"))


def move_cursors(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """(role, noteNumber, moved): each (role, noteNumber, k) moved by its own k valid notes, forwards or backwards; where there are too few it stays, and 0 or a null never moves it.

    Valid numbers are ranked, and each position gets the count of those below and up to it, range by range with the counts of the ranges before carried over; a
    cursor is then joined with the number of the rank it goes to.
    """
    valid = notes.filter("validUrl").select("number").where("number is not null").distinct()
    rows = moves.select("role", F.col("noteNumber").cast("long").alias("noteNumber"), F.col("k").cast("long").alias("k"))
    marks = valid.select("number", F.lit(1).cast("long").alias("v")).unionByName(rows.select(F.col("noteNumber").alias("number")).where("number is not null").distinct().withColumn("v", F.lit(0).cast("long")))
    ranges = Ranges(marks, [], ["number"], like=notes.select("number"))
    below = Window.partitionBy("_range").orderBy("number").rangeBetween(Window.unboundedPreceding, -1)
    d = ranges.with_carried(ranges.rows.withColumn("below", F.coalesce(F.sum("v").over(below), F.lit(0))), [F.sum("v").alias("_n")], {"_before": F.sum("_n")})
    placed = d.withColumn("below", F.col("below") + F.coalesce("_before", F.lit(0)))
    here = placed.groupBy(F.col("number").alias("noteNumber")).agg(F.max("below").alias("below"), F.max("v").alias("own"))
    ranked = placed.where("v = 1").select(F.col("number").alias("to"), F.col("below").alias("rank"))
    rank = F.when(F.col("k") > 0, F.col("below") + F.col("own") + F.col("k") - 1).when(F.col("k") < 0, F.col("below") + F.col("k"))
    found = rows.join(here, "noteNumber", "left").withColumn("rank", rank).join(ranked, "rank", "left")
    return found.select("role", F.coalesce("to", "noteNumber").alias("noteNumber"), F.col("to").isNotNull().alias("moved"))


def move_cursor(notes: DataFrame, cursor: DataFrame, distance: int) -> DataFrame:
    """(role, noteNumber, moved): cursors moved by ``distance`` valid notes; see ``move_cursors``."""
    return move_cursors(notes, cursor.select("role", "noteNumber", F.lit(distance).alias("k")))


def advance_cursors(notes: DataFrame, cursors: DataFrame, roles: DataFrame) -> DataFrame:
    """The cursors, those of ``roles`` on their next valid note; one that isn't there is created on the first; unmoved at the end."""
    at = roles.select("role").distinct().join(cursors.select("role", "noteNumber"), "role", "left")
    moved = move_cursors(notes, at.select("role", F.coalesce("noteNumber", F.lit(-1)).alias("noteNumber"), F.lit(1).alias("k"))).where("moved")
    return upsert(cursors.select("role", "noteNumber", "lockStatus"), moved.select("role", "noteNumber", F.lit("available").alias("lockStatus")), ["role"])


def advance_cursor(notes: DataFrame, cursors: DataFrame, role: str) -> DataFrame:
    """``advance_cursors`` of one role."""
    return advance_cursors(notes, cursors, cursors.sparkSession.createDataFrame([(role,)], "role string"))


def create_cursor(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cursors (role, noteId) on notes that exist, with their numbers."""
    return wanted.join(notes.select(F.col("id").alias("noteId"), F.col("number").alias("noteNumber")), "noteId").select("role", "noteId", "noteNumber")


def cursor_join(cursors: DataFrame, url_status: DataFrame) -> DataFrame:
    """The status row that each cursor is on; a cursor on no row gives none."""
    return cursors.join(url_status, cursors.noteId == url_status.id)


def lock_cursor(cursors: DataFrame, role: str, locked: bool = True) -> DataFrame:
    return cursors.withColumn("lockStatus", F.when(F.col("role") == role, F.lit("locked" if locked else "released")).otherwise(F.col("lockStatus")))


def is_workflow_status(c: Column) -> Column:
    return F.coalesce(c.isin(*WORKFLOW), F.lit(False))


def valid_transition(was: Column, now: Column) -> Column:
    out = F.lit(False)
    for a, following in TRANSITIONS.items():
        out = out | ((was == a) & now.isin(*following))
    return out


def workflow_after(status: Column, has_abstract: Column, failed: Column) -> Column:
    """The state after an extraction."""
    return F.when(failed, F.lit("extractor:fail")).when(has_abstract, F.lit("extractor:success")).otherwise(status)


def add_pdf_flag(table: DataFrame) -> DataFrame:
    """The migration: the flag on every row; ``drop`` undoes it."""
    return table.withColumn("hasPdfLink", F.lit(False))

"""Connected components by randomised contraction, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm.common import Workspace

#: Rounds whose maps are composed in one plan.
COMPOSED = 6


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each end of an edge; component is the smallest id reachable.

    Loops and repeated edges are harmless, an edge with a null end is none; without edges there are no rows.

    In a round each id moves to the one that comes first of itself and its neighbours; the ids moved to are the next round's, joined as their members were.
    Most rounds order ids by a hash drawn for the round: whatever order they have themselves, about half of a chain or of a star are then
    gone in expectation, so that rounds grow as the logarithm of the ids.  The first rounds, and some later ones, order them as they are, since stars are mostly made
    around their smallest id, and such a star is one id after a round.  There is no cap: a round always joins something, and the last is the one that leaves no
    edge.  A hub's edges are pre-aggregated before the shuffle, and joins on a hub have one row a key on the other side, so that AQE can split
    them.  Tables of a round lie in the shared folder until the end; nothing but whether there is an edge comes to the driver.
    """
    work = Workspace(edges.sparkSession, "components")
    links = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    links = work.settle(links.union(links.select("v", "u")).distinct(), "links0", few=True)
    rounds = 0
    while rounds == 0 or not links.isEmpty():
        order = lambda c, k=rounds: F.col(c) if k < 2 or k % 4 == 0 else F.xxhash64(F.col(c), F.lit(k))
        first = links.groupBy("u").agg(F.min_by("v", order("v")).alias("to"))
        moved = work.settle(first.select(F.col("u").alias("id"), F.when(order("to") < order("u"), F.col("to")).otherwise(F.col("u")).alias("to")), f"moved{rounds}", few=True)
        half = links.join(moved.select(F.col("id").alias("v"), F.col("to").alias("y")), "v").select("u", "y").distinct()
        both = half.join(moved.select(F.col("id").alias("u"), F.col("to").alias("x")), "u").where("x <> y")
        rounds += 1
        links = work.settle(both.select(F.col("x").alias("u"), F.col("y").alias("v")).distinct(), f"links{rounds}", few=True)
        work.drop(f"links{rounds - 1}")
    work.drop(f"links{rounds}")

    at = lambda k: work.spark.read.schema("id long, to long").parquet(f"{work.root}/moved{k}")
    whole, interim = at(rounds - 1), [f"moved{k}" for k in range(rounds)]
    for k in range(rounds - 2, -1, -1):
        later = whole.select(F.col("id").alias("to"), F.col("to").alias("last"))
        whole = at(k).join(later, "to", "left").select("id", F.coalesce("last", "to").alias("to"))
        if k and (rounds - 1 - k) % COMPOSED == 0:
            whole = work.settle(whole, f"whole{k}", few=True)
            interim.append(f"whole{k}")
    least = whole.groupBy("to").agg(F.min("id").alias("component"))
    out = work.settle(whole.join(least, "to").select("id", "component"), "components", few=True)
    work.drop(*interim)
    return out

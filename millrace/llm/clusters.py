"""Groups of linked items from shared keys, without writing out the pairs of a group.

Items that share a key are candidates. In a group of a thousand items that are all alike, a thousand
links are as good as half a million: a round compares only some pivots of each key with the key's other
items, verifies those pairs, and joins what is linked. A key is done when all its items are in one
component; otherwise its pivots, which have met all others, leave it, and the next round takes
sixteen times as many pivots, or all items of a small key. So every pair of items that share a key is compared or already joined, in
a number of rounds that grows with the logarithm of a key's items, and the result is the same as that of all pairs.
Which items are pivots does not change the result, only the work: a group of near copies has a centre from
which each copy differs a little, while two copies may differ too much to link. The caller's weight names
likely centres, so that one pivot joins what would otherwise be compared pair by pair.

Components are found by large and small stars: each round hands every item's larger neighbours
to the smallest one. All of it is distributed; minima are combined before each shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from .workspace import Workspace

FIRST_PIVOTS = 16
#: Items of a key up to which, from the second round on, all are pivots.
WHOLE = 64
#: Items of a key up to which, where the keys tell their number, all are pivots in the first round.
FEW = 4


def components(space: Workspace, links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): the smallest node that it reaches."""
    edges = space.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = space.save(moved.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct())
        # stars only: no node is both an end and a centre, and every end has one centre
        roles = new.select(F.col("u").alias("node"), F.lit(1).alias("end"), F.lit(0).alias("centre")).unionByName(new.select(F.col("v").alias("node"), F.lit(0).alias("end"), F.lit(1).alias("centre")))
        if roles.groupBy("node").agg(F.sum("end").alias("end"), F.max("centre").alias("centre")).where("end + centre > 1").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        edges = new


def merged(space: Workspace, known: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) under the links that gave ``known`` and these too. Only a graph of the known
    components that the new links touch is searched."""
    if known is None:
        return space.save(components(space, links))
    for end in ("a", "b"):
        of = known.select(F.col("node").alias(end), F.col("component").alias("__component"))
        links = links.join(of, end, "left").withColumn(end, F.coalesce("__component", end)).drop("__component")
    moved = components(space, links)
    new = moved.select(F.col("node").alias("component"), F.col("component").alias("__new"))
    kept = known.join(new, "component", "left").select("node", F.coalesce("__new", "component").alias("component"))
    return space.save(kept.unionByName(moved.join(known.select("node"), "node", "left_anti").select("node", "component")))


def linked(space: Workspace, keys: DataFrame, verify: Callable[[DataFrame], DataFrame], percent: int, sketches: DataFrame | None = None, fits: Callable[..., Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Components of the items of ``keys`` (col, node, size, room, weight) under verified links, and those links.

    ``room`` is the most that an item can have in common with another from this key on, its ``size`` if unknown:
    if the lesser room is below what both sizes and ``percent`` demand, the two do not meet by this key. Nor do they if ``fits`` denies
    it, which gets the size and the further columns of ``sketches`` (node, ...) of both. If ``keys`` also has ``n``, the number of a key's items
    (or more), keys of up to FEW are compared whole in the first round and done. Of a key, or of a
    cell of it, the item of the largest weight is the pivot. ``verify`` takes pairs (a, b), a < b, each
    once in a round, and gives those that are links.
    """
    own, told = ["col", "node", "size", "room", "weight"], ["node", "size", "room", "component"]
    more = [x for x in sketches.columns if x != "node"] if sketches else []
    central = F.struct((-F.col("weight")).alias("order"), *told)

    def sketched(df: DataFrame) -> DataFrame:
        return df.join(sketches, "node") if sketches else df

    def best(groups: GroupedData) -> DataFrame:
        return groups.agg(F.min(central).alias("p")).select("col", "p.*", F.lit(False).alias("whole"))

    rest = keys.select(*own, F.col("node").alias("component"))
    pivots = best(rest.groupBy("col"))
    open_keys = rest
    if "n" in keys.columns:
        few = keys.where(F.col("n") <= FEW).select("col", (-F.col("weight")).alias("order"), "node", "size", "room", F.col("node").alias("component"), F.lit(True).alias("whole"))
        open_keys = keys.where(F.col("n") > FEW).select(*own)
        pivots = few.unionByName(best(open_keys.withColumn("component", F.col("node")).groupBy("col")))
    links: DataFrame | None = None
    now: DataFrame | None = None
    many = FIRST_PIVOTS
    while True:
        pivot = sketched(pivots).select(F.col("col").alias("key"), "whole", *(F.col(x).alias("pivot" if x == "node" else f"pivot_{x}") for x in told + more))
        near = (100 + percent) * F.least("room", "pivot_room") >= percent * (F.col("size") + F.col("pivot_size"))
        if fits:
            near &= fits(F.col("size"), [F.col(x) for x in more], F.col("pivot_size"), [F.col(f"pivot_{x}") for x in more])
        once = ~F.col("whole") | (F.col("node") < F.col("pivot"))
        met = sketched(rest).join(pivot, (F.col("col") == F.col("key")) & (F.col("component") != F.col("pivot_component")) & once & near)
        pairs = met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        found = space.save(verify(pairs).select("a", "b"))
        # pairs of one component never meet again, so no link is found twice
        links = found if links is None else links.unionByName(found)
        if now is None or not found.isEmpty():
            now = merged(space, now, found)
        left = open_keys.select(*own).join(pivots.select("col", "node"), ["col", "node"], "left_anti")
        placed = left.join(now, "node", "left").select(*own, F.coalesce("component", "node").alias("component"))
        mixed = placed.groupBy("col").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("col", "n")
        rest = space.save(placed.join(mixed, "col"))
        if rest.isEmpty():
            return now, links
        open_keys = rest.where(F.col("n") > WHOLE)
        cells = best(rest.where(F.col("n") > WHOLE).groupBy("col", F.pmod(F.xxhash64("node"), F.lit(many)).alias("cell")))
        pivots = cells.unionByName(rest.where(F.col("n") <= WHOLE).select("col", (-F.col("weight")).alias("order"), *told, F.lit(True).alias("whole")))
        many *= 16

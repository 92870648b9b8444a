"""Problem 2: pairwise matches consolidated into groups.

``shared_value_groups`` finds the groups of items that match (at least ``t`` different values in common), without ever
listing the pairs of a common value; ``components`` gives every linked node the smallest node of its group by Borůvka's
method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.operators.stage import Stage, skew_join

#: Items that share a value are compared pair by pair up to so many; larger groups are refined by further values.
PAIRWISE = 64
#: Items with more shared values than this never hold them in one array; they are counted against all others.
GIANT = 100_000
#: Values by which a group is refined are listed in one array up to so many; beyond, all values of its items are taken.
LISTED = 4096


def _pairs(groups: DataFrame, most: int) -> DataFrame:
    """a < b of different labels among the members (f, c) of each path; groups of at most ``most``."""
    g = groups.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("f", "c"))).alias("m"))
    each = F.transform("m", lambda a, i: F.transform(F.filter(F.slice("m", i + 2, most), lambda b: b["c"] != a["c"]), lambda b: F.struct(a["f"].alias("a"), b["f"].alias("b"))))
    return g.select(F.explode(F.flatten(each)).alias("p")).select("p.*").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    left, right = sets.select(F.col("f").alias("a"), F.col("s").alias("sa")), sets.select(F.col("f").alias("b"), F.col("s").alias("sb"))
    return pairs.join(left, "a").join(right, "b").filter(F.size(F.array_intersect("sa", "sb")) >= t).select("a", "b")


def _stars(rows: DataFrame, key: str) -> DataFrame:
    """a, b: every item f to the smallest with the same key."""
    low = rows.groupBy(key).agg(F.min("f").alias("a"), F.max("f").alias("z")).filter(F.col("a") != F.col("z"))
    return rows.join(low, key).filter(F.col("f") != F.col("a")).select("a", F.col("f").alias("b")).distinct()


def shared_value_groups(rows: DataFrame, item: str, value: str, t: int = 4, pairwise: int = PAIRWISE, giant: int = GIANT, stage: Stage | None = None) -> DataFrame:
    """node, component (smallest item of its group): items linked, directly or through others, by at least ``t`` different
    non-null values in common; items without a match have no row.

    Values that one item alone has are dropped. Each item's values are ordered from rarest to commonest; of two items
    with ``t`` common values, the i-th rarest common one is, in each, not among its ``t - i`` commonest. So items meet at
    values outside their ``t - 1`` commonest. Where at most ``pairwise`` items meet, their pairs are verified on the full
    sets. Larger groups need only show which groups of items they connect:

    * items with ``t`` neighbouring common values alike are linked at once, one row for each value of an item. This joins
      what shares many common values; groups so far are computed, and a meeting of items that all belong to one is done;
    * the remaining meetings are refined by the next common value, and so on. All pairs of a meeting that matter have an
      item outside the meeting's largest group, so only values of such items are followed, by all. Items that have met by
      ``t`` values match, and each is linked to the smallest.

    No pair is lost at any size of a group. The refinement costs a row for each value that an item of a meeting shares with
    an item of another group; it grows beyond that only where very many items share several common values but not ``t``.
    Items with more than ``giant`` shared values (there are at most rows / ``giant``) are counted against all others by a
    join instead. Repeated rows count once; rows with a null item or value do not count; an empty table gives none.
    """
    spark = rows.sparkSession
    stage = stage or Stage(spark, "groups")
    tokens = stage.put(rows.select(F.col(item).cast("bigint").alias("f"), F.col(value).cast("bigint").alias("h")).dropna().distinct())
    freq = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    known = stage.put(skew_join(tokens, freq, "h"))
    stage.drop(tokens)
    large = stage.put(known.groupBy("f").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > giant).select("f"))
    small, links = known, None
    if not large.isEmpty():
        own = known.join(large, "f").select(F.col("f").alias("a"), "h")
        links = own.join(known, "h").filter(F.col("a") != F.col("f")).groupBy("a", "f").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= t).select("a", F.col("f").alias("b"))
        small = known.join(large, "f", "left_anti")
    cold = F.size(F.filter("s", lambda x: x["n"] <= pairwise))
    sets = small.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("s")).filter(F.size("s") >= t)
    sets = stage.put(sets.select("f", cold.alias("cold"), F.transform("s", lambda x: x["h"]).alias("s")))

    first = F.transform(F.slice("s", F.lit(1), F.size("s") - t + 1), lambda h, i: F.struct(F.array(h).alias("path"), (i + 1).alias("at")))
    met = stage.put(sets.select("f", F.explode(first).alias("x")).select("f", "x.*"))
    sizes = stage.put(met.groupBy("path").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > 1))
    few = _pairs(met.join(sizes.filter(F.col("k") <= pairwise), "path").select("path", "f", F.col("f").alias("c")), pairwise)
    pairs = _verified(few, sets, t)
    links = pairs if links is None else links.unionByName(pairs)
    many = sizes.filter(F.col("k") > pairwise).select("path")
    if many.isEmpty():
        groups = components(links, stage=stage)
        stage.drop(known, met, sizes)
        return groups
    met = stage.put(skew_join(met, many, "path"))
    hot = F.slice("s", F.col("cold") + 1, F.size("s"))
    runs = F.transform(F.sequence(F.lit(1), F.size("h") - t + 1), lambda i: F.slice("h", i, t))
    runs = stage.put(sets.select("f", hot.alias("h")).filter(F.size("h") >= t).select("f", F.explode(runs).alias("run")))
    links = links.unionByName(_stars(runs, "run"))
    groups = stage.put(components(links, stage=stage))
    stage.drop(known, sizes, runs)

    label = F.coalesce("component", "f").alias("c")
    met = stage.put(met.join(groups.withColumnRenamed("node", "f"), "f", "left").select("f", label, "path", "at"))
    more = None
    for level in range(2, t + 1):
        by = met.groupBy("path", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(F.sum("n").alias("k"), F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "c")).alias("top"))
        wide = stage.put(by.filter((F.col("labels") > 1) & (F.col("k") > pairwise if level == 2 else F.lit(True))).select("path", "k", F.col("top.c").alias("major")))
        if level > 2:
            found = _verified(_pairs(met.join(wide.filter(F.col("k") <= pairwise).select("path"), "path"), pairwise), sets, t)
            more = found if more is None else more.unionByName(found)
        wide = wide.filter(F.col("k") > pairwise)
        if wide.isEmpty():
            break
        met = stage.put(_refined(met, wide, sets, t - level, stage))
        if level == t:
            stars = _stars(met, "path")
            more = stars if more is None else more.unionByName(stars)
    if more is None:
        return groups
    more = stage.put(more)
    if more.isEmpty():
        return groups
    named = lambda end: groups.select(F.col("node").alias(end), F.col("component").alias(f"{end}c"))
    ends = more.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b"))
    joined = stage.put(components(ends.filter("a != b").distinct(), stage=stage).select(F.col("node").alias("component"), F.col("component").alias("whole")))
    alone = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(groups, "node", "left_anti").select("node", F.col("node").alias("component"))
    return groups.unionByName(alone).join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))


def _refined(met: DataFrame, wide: DataFrame, sets: DataFrame, later: int, stage: Stage) -> DataFrame:
    """f, c, path, at: the members of the meetings ``wide`` by one further value, at most ``later`` before an item's last,
    of those that an item outside the meeting's largest group (``major``) has."""
    members = stage.put(skew_join(met, wide, "path").join(sets.select("f", "s"), "f"))
    tail = F.slice("s", F.col("at") + 1, F.greatest(F.size("s") - later - F.col("at"), F.lit(0)))
    minor = members.filter(F.col("c") != F.col("major")).select("path", tail.alias("tail"))
    short = minor.groupBy("path").agg(F.sum(F.size("tail")).alias("n")).filter(F.col("n") <= LISTED)
    listed = minor.join(short, "path").groupBy("path").agg(F.array_distinct(F.flatten(F.collect_list("tail"))).alias("only"))
    rows = members.join(listed, "path", "left")
    steps: Column = F.when(F.col("only").isNull(), tail).otherwise(F.array_intersect(tail, "only"))
    rows = rows.select("f", "c", "path", "s", F.explode(steps).alias("h"))
    return rows.select("f", "c", F.concat("path", F.array("h")).alias("path"), F.array_position("s", F.col("h")).cast("int").alias("at"))


def components(links: DataFrame, a: str = "a", b: str = "b", stage: Stage | None = None) -> DataFrame:
    """node, component (smallest node of its group), a row for each node of ``links``.

    Deterministic Borůvka hooking. In each round every component hooks onto the neighbour at the other end of its
    smallest outgoing edge; edges are ordered by their two ends, smaller end first, which is the same from both sides, so
    hooks form trees but for one pair of components that chose the same edge, of which the smaller is the root. Trees
    collapse by pointer doubling; edges are relabelled by their components and deduplicated; edges within a component
    disappear. A round at least halves the components that have an edge, so billions of links need some 30 rounds at
    most. All steps are joins and partial aggregations on stored tables: no component is ever gathered. The key of a hub or
    of a huge component is hot on one side only, has one row on the other, and each join's result is written at once, so
    that AQE may split it. Null ends are ignored, loops give a
    component of one, repeated and reversed links change nothing, and no links give no rows.
    """
    spark = links.sparkSession
    stage = stage or Stage(spark, "components")
    e0 = links.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).dropna()
    e0 = stage.put(e0.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = stage.put(e0.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    edges = stage.put(e0.filter(F.col("a") != F.col("b")))
    stage.drop(e0)
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("to"), "a", "b"), F.struct(F.col("b").alias("v"), F.col("a").alias("to"), "a", "b"))).alias("x")).select("x.*")
        hook = ends.groupBy("v").agg(F.min(F.struct("a", "b", "to")).alias("m")).select("v", F.col("m.to").alias("p"))
        hook = stage.put(hook)
        # the two components that chose one edge point at each other: the smaller becomes the root
        back = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        tree = stage.put(hook.join(back, "p", "left").select("v", F.when((F.col("pp") == F.col("v")) & (F.col("v") < F.col("p")), F.col("v")).otherwise(F.col("p")).alias("p")))
        stage.drop(hook)
        while True:
            up = tree.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            nxt = stage.put(tree.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            stage.drop(tree)
            tree = nxt.select("v", "p")
            tree._stage_path = nxt._stage_path
            if nxt.filter("moved").isEmpty():
                break
        to = tree.select(F.col("v").alias("component"), "p")
        new_label = stage.put(label.join(to, "component", "left").select("node", F.coalesce("p", "component").alias("component")))
        half = stage.put(edges.join(tree.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").select("pa", "b"))
        full = half.join(tree.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b").filter(F.col("pa") != F.col("pb"))
        new_edges = stage.put(full.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        for old in (label, edges, half, tree):
            stage.drop(old)
        label, edges = new_label, new_edges
    # roots are some node of the group; name it after its smallest
    low = label.groupBy("component").agg(F.min("node").alias("low"))
    return label.join(low, "component").select("node", F.col("low").alias("component"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "p2")
    out = shared_value_groups(spark.read.parquet(f"{sf_dir}/fingerprints.parquet"), "file_id", "hash", 4, stage=stage)
    return stage.finish(out.select(F.col("node").alias("file_id"), F.col("component").alias("group_id")))

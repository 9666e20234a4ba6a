"""From candidate groups to classes, without all pairs of a group.

Rows (grp, node) say which nodes may be alike. Only the classes that verified links
join matter, so a group need not be expanded. First its most popular member is
compared with every other one (a star) and classes are joined. Then members outside
the group's largest class are compared with some of that class, drawn by a hash: 16,
then 64. A family whose members are alike with some probability collapses so in
rounds of linear size. What is left, members whose group still holds other classes,
is compared across classes, so no link between classes is lost: pair by pair, of which
``narrow`` may choose those that can be alike, or, in large groups, by ``settle``. A link
is the same thing on either way. Where ``narrow`` chooses, rounds end as soon as one
brings little.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import discard, stage

#: Members of the largest class that the others meet, by round; the first is a star.
DELEGATES = (1, 16, 64)
#: Edges that one task contracts, 16 bytes each.
EDGES_PER_TASK = 1_000_000
#: Members of a group from which on ``settle`` is asked.
LARGE = 64
#: Rounds go on while the pairs left outnumber the members left by this factor.
PAIRS_PER_MEMBER = 4
#: Before ``narrow``, they also end after one that leaves more than this share of the pairs.
STILL_LEFT = 0.9


def forest(edges: DataFrame) -> DataFrame:
    """Per partition of (u, v), edges (node, smallest node of its class in the partition)."""

    def run(batches):
        us, vs = [], []
        for batch in batches:
            us.append(batch.column(0).to_numpy())
            vs.append(batch.column(1).to_numpy())
        if not us:
            return
        names, ends = np.unique(np.concatenate([*us, *vs]), return_inverse=True)
        u, v = np.split(ends, 2)
        root = np.arange(len(names))
        while True:
            # Hook each root to the smallest neighbouring root, then jump pointers to their ends.
            a, b = root[u], root[v]
            if (a == b).all():
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
        inner = np.flatnonzero(root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[inner]), pa.array(names[root[inner]])], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the smallest node of its class.

    Edges are contracted to forests in parts of at most ``EDGES_PER_TASK``. If that took
    one part it is done; else alternating large-star and small-star rounds join the
    parts' forests, each round's edges being a written table.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    parts = -(-edges.count() // EDGES_PER_TASK)
    edges = stage(forest(edges.repartition(max(1, parts))), "forest")
    seen = mark(edges) if parts > 1 else None
    while seen and seen[0]:
        sides = both(edges)
        low = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"))
        large = sides.where("v > u").join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(low, F.col("u") == F.col("c"))
        edges = stage(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("c", "m")).distinct(), "small-star"
        )
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)


def link(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    narrow: Callable[[DataFrame], DataFrame] | None = None,
    sketches: DataFrame | None = None,
    close: Callable[[Column, Column], Column] | None = None,
    settle: Callable[[DataFrame], DataFrame] | None = None,
    delegates: tuple[int, ...] = DELEGATES,
) -> DataFrame:
    """Classes of ``members`` (grp, node): (node, comp) of the nodes that have a verified link.

    ``verify`` takes distinct pairs (a, b), a < b, and returns those that are alike.
    ``close`` may tell by two sketches, of ``sketches`` (node, sketch), that a pair can't
    be; it is part of the join condition, so such pairs are never rows. ``narrow`` takes
    rows (grp, node, comp, sketch) and gives pairs (node, other) across classes, among them all that
    are alike; without it members meet by their group. ``settle`` takes what is left of
    groups of more than ``LARGE`` members, (grp, node, comp), and gives links, by the same rule as
    ``verify``, that join all their classes that have any.
    """
    if sketches is None:
        sketches, close = members.select("node", F.lit(0).alias("sketch")).distinct(), lambda x, y: F.lit(True)
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = members.join(sizes, "grp")
    popular = kept.groupBy("node").agg(F.sum("n").alias("pop"))
    left = stage(kept.select("grp", "node").join(popular, "node"), "members")
    labels, links, tested, settled, before, done = None, None, None, None, None, []
    for turn in range(len(delegates) + 1):
        if labels is None:
            now = left.withColumn("comp", F.col("node"))
        else:
            now = left.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        per = now.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("k"))
        open_groups = (
            per.groupBy("grp")
            .agg(
                F.count(F.lit(1)).alias("comps"),
                F.sum("k").alias("n"),
                F.sum(F.col("k") * F.col("k")).alias("own"),
                F.max(F.struct("k", "comp"))["comp"].alias("main"),
            )
            .where("comps > 1")
            .select("grp", "n", "main", ((F.col("n") * F.col("n") - F.col("own")) / 2).alias("cross"))
        )
        now = stage(now.join(open_groups, "grp").join(sketches, "node"), "open")
        done.append(now)
        total = open_total(now)
        if not total[0]:
            break
        last = turn == len(delegates) or total[1] <= PAIRS_PER_MEMBER * total[0]
        last |= narrow is not None and before is not None and total[1] > STILL_LEFT * before
        before = total[1]
        if last and settle is not None:
            big = now.where(F.col("n") > LARGE).select("grp", "node", "comp")
            if not big.isEmpty():
                settled = stage(settle(big), "settled")
                links = settled if links is None else links.unionByName(settled)
            now = now.where(F.col("n") <= LARGE)
        if last:
            if narrow is not None:
                pairs = narrow(now.select("grp", "node", "comp", "sketch"))
            else:
                rest = now.select("grp", F.col("node").alias("other"), F.col("comp").alias("other_comp"), F.col("sketch").alias("seen"))
                pairs = now.join(rest, "grp").where((F.col("comp") < F.col("other_comp")) & close(F.col("sketch"), F.col("seen")))
        elif turn == 0:
            best = F.max(F.struct("pop", (-F.col("node")).alias("m"), "sketch"))
            leaders = now.groupBy("grp").agg((-best["m"]).alias("other"), best["sketch"].alias("seen"))
            pairs = now.join(leaders, "grp").where("node <> other").where(close(F.col("sketch"), F.col("seen")))
        else:
            # The limit on the rank is applied before the shuffle too, so a class is never sorted whole.
            drawn = Window.partitionBy("grp").orderBy(F.xxhash64("node", F.lit(turn)))
            some = now.where("comp = main").withColumn("place", F.row_number().over(drawn)).where(F.col("place") <= delegates[turn])
            outside = now.where("comp <> main").select("grp", "node", "sketch")
            pairs = outside.join(some.select("grp", F.col("node").alias("other"), F.col("sketch").alias("seen")), "grp")
            pairs = pairs.where(close(F.col("sketch"), F.col("seen")))
        pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        found = stage(verify(pairs), "links")
        done += [pairs, found]
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if labels is None or settled is not None or not found.isEmpty():
            labels = stage(components(links), "labels")
        if last:
            break
        # The star has compared the members of a group of two.
        left = now.where("n > 2").select("grp", "node", "pop")
    discard(*done)
    if labels is None:
        return members.select("node", F.col("node").alias("comp")).where("false")
    return labels


def open_total(now: DataFrame):
    """(members, pairs) that unresolved groups still hold."""
    return now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("cross") / F.col("n")), F.lit(0.0))).first()

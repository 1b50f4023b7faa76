"""Loops over edge sets: transitive closure and groups of equal individuals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.operators.joins import key_join, union_all
from ontomill.sources.scratch import Scratch


@dataclass
class Condensed:
    """A graph with every cycle taken as one node, and its closure.

    ``groups`` ``(node, root)`` lists the members of cycles, the smallest as the root; None if
    there are no cycles. ``steps`` and ``closed`` ``(src, dst)`` are the edges between roots
    and nodes on no cycle, and all pairs joined by a path of them; neither holds a cycle.
    ``rounds`` has the rows of ``closed`` after each round.
    """

    steps: DataFrame
    groups: DataFrame | None
    closed: DataFrame
    rounds: list[int]

    def members(self, pairs: DataFrame) -> DataFrame:
        """``(src, dst)`` pairs of roots written out for all members of their groups."""
        if self.groups is None:
            return pairs
        for end in ("src", "dst"):
            inside = self.groups.select(F.col("node").alias("_node"), F.col("root").alias(end))
            pairs = pairs.join(inside, end, "left").withColumn(end, F.coalesce("_node", end))
            pairs = pairs.select("src", "dst")
        return pairs


def condense(edges: DataFrame) -> Condensed:
    """Condense and close a graph given as ``(src, dst)``.

    Edges that run both ways are contracted first; what cycles are left are found by
    ``_cycles``. Paths are then doubled: with ``S`` the pairs
    joined by exactly 2**k edges and ``T`` those joined by fewer, the next ``T`` is ``T``, ``S``
    and ``S`` followed by ``T``, so a graph whose longest path has n edges takes log2(n) rounds
    and a pair is not put together over and over for each point between its ends.
    """
    scratch = Scratch(edges.sparkSession)
    # One row for the edges between two nodes, whichever way they run.
    pairs = (
        edges.filter(F.col("src") != F.col("dst"))
        .groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
        .agg(F.min("src").alias("a"), F.max("src").alias("b"))
    )
    pairs, figures = scratch.cut_figures(pairs, rows="count(1)", both="count_if(a <> b)")
    rows, groups = figures["rows"] + figures["both"], None
    steps = pairs.selectExpr(
        "inline(if(a <> b, array(struct(lo AS src, hi AS dst), struct(hi AS src, lo AS dst)),"
        " array(struct(a AS src, if(a = lo, hi, lo) AS dst))))"
    )
    if figures["both"]:
        mutual = pairs.filter("a <> b").select(F.col("lo").alias("ind"), F.col("hi").alias("same"))
        groups = same_as_groups(mutual).select(F.col("ind").alias("node"), F.col("same").alias("root"))
        steps, groups, rows = _contract(scratch, steps, None, groups)
    powers, acyclic = _powers(scratch, steps, rows)
    if not acyclic:
        steps, groups, rows = _contract(
            scratch, steps, groups, scratch.cut(_cycles(scratch, steps, powers))
        )
        powers, _ = _powers(scratch, steps, rows)
    closed, rounds = steps, [rows]
    for power in powers[1:]:
        onward = power.select("src", F.col("dst").alias("_mid"))
        longer = key_join(onward, closed.withColumnRenamed("src", "_mid"), ["_mid"])
        paths = union_all([closed, power, longer.select("src", "dst")])
        closed, n = scratch.cut_rows(paths.dropDuplicates())
        rounds.append(n)
    return Condensed(steps, groups, closed, rounds)


def _contract(
    scratch: Scratch, steps: DataFrame, groups: DataFrame | None, joined: DataFrame
) -> tuple[DataFrame, DataFrame, int]:
    """Take the nodes of ``joined`` ``(node, root)`` together in the edges and the groups."""
    for end in ("src", "dst"):
        roots = joined.select(F.col("node").alias(end), F.col("root").alias("_root"))
        other = "dst" if end == "src" else "src"
        steps = steps.join(roots, end, "left").select(F.coalesce("_root", end).alias(end), other)
    steps = steps.filter(F.col("src") != F.col("dst")).select("src", "dst")
    steps, rows = scratch.cut_rows(steps.dropDuplicates())
    if groups is not None:
        moved = joined.select(F.col("node").alias("root"), F.col("root").alias("_root"))
        before = groups.join(moved, "root", "left").select("node", F.coalesce("_root", "root").alias("root"))
        joined = before.unionByName(key_join(joined, groups, ["node"], "left_anti"))
        joined = scratch.cut(joined)
    return steps, joined, rows


def _powers(scratch: Scratch, steps: DataFrame, rows: int) -> tuple[list[DataFrame], bool]:
    """The pairs joined by exactly 1, 2, 4, ... edges, and whether there are no cycles.

    Without cycles the list ends with the longest path; else it ends where paths have more
    edges than the graph has ``rows``, as no path without a repeat has.
    """
    powers, length = [steps], 1
    while rows and length <= rows:
        onward = powers[-1].select(F.col("src").alias("_mid"), F.col("dst").alias("_end"))
        twice = key_join(powers[-1].withColumnRenamed("dst", "_mid"), onward, ["_mid"])
        twice = twice.select("src", F.col("_end").alias("dst")).dropDuplicates()
        twice, n = scratch.cut_rows(twice)
        if not n:
            return powers, True
        powers.append(twice)
        length *= 2
    return powers, not rows


def _cycles(scratch: Scratch, steps: DataFrame, powers: list[DataFrame]) -> DataFrame:
    """``(node, root)`` of all nodes that are on a cycle, the smallest of it as the root;
    ``powers`` are those of ``steps``, as ``_powers`` gives them for a graph with cycles.

    Nodes that neither a cycle reaches nor reach one are put aside. Of what is left, every
    node gets the smallest label that reaches it and the smallest that it reaches, both by
    doubling; where they agree, the node is on a cycle with the node of that label. Edges
    between nodes that differ in one of the two lie on no cycle, and the search goes on
    among the others. Labels are hashes, so few searches are needed.
    """
    found = []
    while True:
        long = powers[-1]
        core = long.select(F.col("src").alias("node")).intersect(long.select(F.col("dst").alias("node")))
        label = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n"))
        labels = core.select("node", label.alias("above"), label.alias("below"))
        labels = scratch.cut(labels)
        for power in powers:
            from_above = power.select(F.col("src").alias("node"), F.col("dst").alias("to"))
            from_above = key_join(from_above, labels, ["node"]).select(
                F.col("to").alias("node"), "above", F.lit(None).cast(labels.schema["below"].dataType).alias("below")
            )
            from_below = power.select(F.col("dst").alias("node"), F.col("src").alias("to"))
            from_below = key_join(from_below, labels, ["node"]).select(
                F.col("to").alias("node"), F.lit(None).cast(labels.schema["above"].dataType).alias("above"), "below"
            )
            near = union_all([labels, from_above, from_below])
            near = near.groupBy("node").agg(F.min("above").alias("above"), F.min("below").alias("below"))
            labels = scratch.cut(key_join(near, core, ["node"], "left_semi"))
        agree = F.col("above") == F.col("below")
        same = labels.filter(agree).select("node", F.col("above.n").alias("root"))
        least = same.groupBy("root").agg(F.min("node").alias("_least"), F.count(F.lit(1)).alias("_n"))
        found.append(
            scratch.cut(
                key_join(same, least.filter("_n > 1"), ["root"]).select("node", F.col("_least").alias("root"))
            )
        )
        rest = labels.filter(~agree)
        for end in ("src", "dst"):
            ends = rest.select(
                F.col("node").alias(end), F.struct("above", "below").alias(f"_{end}")
            )
            steps = key_join(steps, ends, [end])
        steps, rows = scratch.cut_rows(
            steps.filter(F.col("_src") == F.col("_dst")).select("src", "dst")
        )
        powers, acyclic = _powers(scratch, steps, rows)
        if acyclic:
            return union_all(found)


def transitive_closure(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """All ``(src, dst)`` joined by a path of one or more edges.

    The graph is condensed first and paths are doubled, see ``condense``; the pairs of cycles
    are written out at the end. The result can be quadratic in the number of nodes.
    """
    edges = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    graph = condense(edges)
    parts = [graph.members(graph.closed), edges.filter(F.col("src") == F.col("dst"))]
    if graph.groups is not None:
        inside = graph.groups.select("root", F.col("node").alias("dst"))
        around = key_join(graph.groups.withColumnRenamed("node", "src"), inside, ["root"])
        parts.append(around.select("src", "dst"))
    pairs = union_all(parts).dropDuplicates()
    return pairs.select(F.col("src").alias(src), F.col("dst").alias(dst))


def same_as_closure(same_as: DataFrame) -> DataFrame:
    """Transitive closure of ``(ind, same)`` exactly as the pairs are directed.

    A group of n equal individuals linked in both directions yields n² rows; use
    ``same_as_groups`` for the same knowledge in n rows.
    """
    return transitive_closure(same_as, "ind", "same")


def same_as_groups(same_as: DataFrame) -> DataFrame:
    """``(ind, same)`` from each individual to the smallest one it is equal to.

    Links count in both directions and chains are followed to the end; the smallest
    individual of a group is listed with itself. Works by alternating "large star"
    and "small star" steps (Kiveris et al., Connected Components in MapReduce and
    Beyond, 2014): every step points the neighbours of a node at the smallest of
    them. The number of rounds grows with the logarithm of the longest chain, no
    group is ever gathered in one task, and the partitions of a
    node with very many neighbours are split by adaptive execution.
    """
    scratch = Scratch(same_as.sparkSession)
    links = same_as.select(
        F.greatest("ind", "same").alias("node"), F.least("ind", "same").alias("root")
    ).dropDuplicates()
    links = scratch.cut(links.filter(F.col("node") != F.col("root")))
    while not _are_stars(links):
        links = scratch.cut(_small_star(_large_star(links)))
    roots = links.select(F.col("root").alias("ind"), F.col("root").alias("same"))
    members = links.select(F.col("node").alias("ind"), F.col("root").alias("same"))
    return members.unionByName(roots.dropDuplicates())


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one root and no root is a node."""
    ends = links.selectExpr("inline(array(struct(node AS x, 1 AS up, 0 AS down), struct(root AS x, 0 AS up, 1 AS down)))")
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node at the smallest of the node's circle."""
    both = links.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(
        links.select(F.col("root").alias("u"), F.col("node").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = key_join(both, least, ["u"]).filter(F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("node"), F.col("m").alias("root")).dropDuplicates()


def _small_star(links: DataFrame) -> DataFrame:
    """Point every smaller neighbour of a node, and the node, at the smallest of them."""
    least = links.groupBy("node").agg(F.min("root").alias("m"))
    moved = key_join(links, least, ["node"])
    neighbours = moved.select(F.col("root").alias("node"), F.col("m").alias("root"))
    own = least.select("node", F.col("m").alias("root"))
    return (
        neighbours.unionByName(own).filter(F.col("node") != F.col("root")).dropDuplicates()
    )

"""Groups of equal individuals that are kept up while links are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontomill.operators.closure import same_as_groups
from ontomill.operators.joins import key_join
from ontomill.sources.scratch import Scratch

#: Facts and members of a group that are written out under one key, and rows of one task. A task
#: meets few different facts, each member's rows stand together, and the facts come round after
#: ``PIECE`` rows, so that Parquet keeps its dictionaries and a row takes a fraction of a byte.
PIECE = 256
SLAB = 4_096
ROWS_A_TASK = 8_000_000

#: Parts of the table that are read side by side before they are written as one.
MOST_PARTS = 6


class Components:
    """Each individual that equals another, with the smallest of its group.

    The table is a list of parts; a row of a later part replaces those of earlier ones.
    New links are first taken to the groups they join, and only these groups are put
    together and written anew. What no link touches is not read again, except when the
    parts have become many and are merged.
    """

    def __init__(self, scratch: Scratch):
        self.scratch = scratch
        self.parts: list[DataFrame] = []

    def table(self) -> DataFrame | None:
        """``(ind, root)``; a root is listed with itself. None while there is no group."""
        now = None
        for part in self.parts:
            now = part if now is None else key_join(now, part, ["ind"], "left_anti").unionByName(part)
        return now

    def add(self, links: DataFrame) -> DataFrame | None:
        """Take in links ``(ind, same)``, whichever way round; return the ``(ind, root)`` of
        all members of groups that changed, or None if none did."""
        now = self.table()
        joins = links.select("ind", "same")
        if now is not None:
            for end in ("ind", "same"):
                roots = now.select(F.col("ind").alias(end), F.col("root").alias("_root"))
                joins = joins.join(roots, end, "left").select(
                    F.coalesce("_root", end).alias(end), "same" if end == "ind" else "ind"
                )
        joins = self.scratch.cut(joins.filter(F.col("ind") != F.col("same")).dropDuplicates())
        if joins.isEmpty():
            return None
        merged = same_as_groups(joins.select("ind", "same")).withColumnRenamed("same", "root")
        if now is not None:
            members = key_join(
                now.withColumnRenamed("root", "_old"),
                merged.withColumnRenamed("ind", "_old"),
                ["_old"],
            ).select("ind", "root")
            merged = members.unionByName(merged).dropDuplicates()
        changed = self.scratch.cut(merged)
        self.parts.append(changed)
        if len(self.parts) > MOST_PARTS:
            self.parts = [self.scratch.cut(self.table())]
        return changed


def spread(facts: DataFrame, groups: DataFrame, end: str) -> DataFrame:
    """The facts with ``end`` replaced by every member of its group.

    What is known of any member is gathered at the root, once, and handed to all members.
    """
    up = groups.select(F.col("ind").alias(end), "root")
    gathered = key_join(facts, up, [end]).drop(end).dropDuplicates()
    down = groups.select("root", F.col("ind").alias(end))
    return key_join(gathered, down, ["root"]).select(*facts.columns)


def gather(facts: DataFrame, groups: DataFrame, end: str) -> DataFrame:
    """The facts of members other than the root, with ``end`` replaced by the root."""
    up = groups.filter("ind <> root").select(F.col("ind").alias(end), "root")
    moved = key_join(facts, up, [end])
    return moved.withColumn(end, F.col("root")).select(*facts.columns)


def written_out(facts: DataFrame, groups: DataFrame, ends: list[str]) -> DataFrame:
    """Distinct ``facts`` with each of ``ends`` replaced by every member of its group.

    A fact is brought to the roots and made distinct; only then the members are joined, so
    the rows, which can be quadratic in the size of a group, are neither shuffled nor sorted
    afterwards. Facts come in pieces and members in slabs, each slab meets each piece: no key has
    more than some ``PIECE`` times ``SLAB`` rows, however large its group, and there are as many
    tasks as the rows ask for, not the bytes that go in.
    """
    columns = facts.columns
    for end in ends:
        up = groups.select(F.col("ind").alias(end), F.col("root").alias("_root"))
        facts = facts.join(up, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    facts = facts.select(*columns).dropDuplicates()
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("_members"))
    counted = facts.withColumn("_rows", F.lit(1).cast("long"))
    for end in ends:
        own = sizes.withColumnRenamed("root", end)
        known = counted.groupBy(end).agg(F.sum("_rows").alias("_facts"))
        facts = _for_members(facts, groups, key_join(own, known, [end]), end)
        rows = F.col("_rows") * F.coalesce("_members", F.lit(1))
        counted = counted.join(own, end, "left").select(*columns, rows.alias("_rows"))
    return facts


def _for_members(facts: DataFrame, groups: DataFrame, counts: DataFrame, end: str) -> DataFrame:
    """The facts with ``end``, if it is a root, replaced by every member of its group; ``counts``
    ``(end, _members, _facts)`` has the members and facts of each root that has both."""
    columns, key = facts.columns, [end, "_slab", "_piece"]
    rows = counts.agg(F.sum(F.col("_members") * F.col("_facts"))).first()[0] or 0
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(parts, -(-rows // ROWS_A_TASK))
    slabs, pieces = F.ceil(F.col("_members") / SLAB), F.ceil(F.col("_facts") / PIECE)
    grid = counts.select(end, slabs.alias("_slabs"), pieces.alias("_pieces"))

    def each(number: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(number) - 1))

    own = facts.join(grid, end, "left")
    piece = F.pmod(F.xxhash64(*columns), F.col("_pieces"))
    cut = own.filter("_slabs IS NOT NULL").select(*columns, each("_slabs").alias("_slab"), piece.alias("_piece"))
    slab = F.pmod(F.xxhash64("ind"), F.col("_slabs"))
    members = key_join(groups.withColumnRenamed("root", end), grid, [end])
    # Dealt out before they are repeated, as those of one group come from one task.
    members = members.select(end, "ind", slab.alias("_slab"), "_pieces").repartition(parts, "ind")
    members = members.select(end, "ind", "_slab", each("_pieces").alias("_piece"))
    # For each member in turn the facts of a piece, which wait on the right. The number of tasks is
    # given, as the planner would put few bytes into few tasks.
    met = members.repartition(tasks, *key).join(cut.repartition(tasks, *key).hint("merge"), key)
    met = met.drop(end).withColumnRenamed("ind", end).select(*columns)
    return met.unionByName(own.filter("_slabs IS NULL").select(*columns))

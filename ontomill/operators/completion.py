"""Subclasses that follow from existential restrictions, intersections and property chains.

Completion by rules over two growing tables: ``subs`` ``(cls, supclass)``, every class below
which others, and ``links`` ``(cls, prop, filler)``, every class whose members all have a
``prop`` link to a member of ``filler``. With axioms in the normal forms

    A below B;  A1 and A2 below B;  A below (some r B);  (some r A) below B;
    r below s;  r then s below t

a round applies each rule to what the round before brought, joined with all that is known:

* A below B1 and B2, ``B1 and B2 below C``: A below C
* A below B, ``B below (some r C)``: A links to C by r and by the properties above r
* A links to B by r, B below C, ``(some r C) below D``: A below D
* A links to B by r, B links to C by s, ``r then s below t``: A links to C by t

The steps that axioms state are closed beforehand, so a deep hierarchy costs no rounds; the
number of rounds is that of restrictions that follow from one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.kb import KnowledgeBase
from ontomill.operators import edges as E
from ontomill.operators.closure import transitive_closure
from ontomill.operators.joins import key_join, new_rows, union_all
from ontomill.schema import OWL_THING
from ontomill.sources.scratch import Scratch

#: Parts of a growing table that are looked up one by one before they are written as one.
MOST_PARTS = 6


class _Growing:
    """A table as the parts that the rounds added, and the newest of them."""

    def __init__(self, scratch: Scratch):
        self.scratch = scratch
        self.parts: list[DataFrame] = []
        self.newest: DataFrame | None = None

    def add(self, candidates: list[DataFrame]) -> None:
        """Keep the candidates that are new; they are the newest part, or there is none."""
        self.newest = None
        if not candidates:
            return
        part, rows = self.scratch.cut_rows(new_rows(union_all(candidates), self.parts))
        if rows:
            if len(self.parts) >= MOST_PARTS:
                self.parts = [self.scratch.cut(union_all(self.parts))]
            self.parts.append(part)
            self.newest = part

    @property
    def whole(self) -> DataFrame:
        return union_all(self.parts)


def restrictions(kb: KnowledgeBase) -> tuple[DataFrame, DataFrame]:
    """``(cls, prop, filler)`` for "cls below (some prop filler)", and the same for
    "(some prop filler) below cls". A property's domain is the latter, for any filler."""
    one = [
        kb[t].filter("card >= 1").select("cls", "prop", F.col("clss").alias("filler"))
        for t in ("subclass_of_min_cardinality", "equivalent_to_min_cardinality")
    ]
    some = [
        kb[t].select("cls", "prop", F.col("range").alias("filler"))
        for t in ("subclass_of_some", "equivalent_to_some")
    ]
    exactly = kb["equivalent_to_min_cardinality"].filter("card = 1")
    domain = kb["op_domain"].select(
        F.col("domain").alias("cls"), F.col("property").alias("prop"), F.lit(OWL_THING).alias("filler")
    )
    below = union_all([*some, *one])
    above = union_all([some[1], exactly.select("cls", "prop", F.col("clss").alias("filler")), domain])
    return below.dropDuplicates(), above.dropDuplicates()


def _properties_above(kb: KnowledgeBase) -> DataFrame:
    """``(prop, super_prop)`` that follows, a property not being above itself."""
    equal = kb["equivalent_property"]
    steps = union_all(
        [
            kb["sub_property_of"],
            equal.select(F.col("cls").alias("prop"), F.col("equiv").alias("super_prop")),
            equal.select(F.col("equiv").alias("prop"), F.col("cls").alias("super_prop")),
        ]
    )
    closed = transitive_closure(steps, "prop", "super_prop")
    return closed.filter(F.col("prop") != F.col("super_prop"))


def completed_steps(
    kb: KnowledgeBase, told: DataFrame, chains: DataFrame | None = None
) -> DataFrame:
    """The ``told`` steps ``(cls, supclass)`` and those that completion adds to them.

    ``chains`` ``(first, second, whole)`` states property chains; a transitive property is a
    chain of itself and itself. All that follows by the rules above is reached through the
    steps; unions, negations, ranges, inverses and numbers above one are not used, and classes
    without members are not looked for.
    """
    axioms = ("subclass_of_some", "equivalent_to_some", "equivalent_to_intersection",
              "subclass_of_min_cardinality", "equivalent_to_min_cardinality")
    if not kb.has_any(*axioms):
        return told
    scratch = Scratch(kb.spark)
    told = scratch.cut(told)
    pairs = scratch.cut(E.equivalent_intersection_whole(kb))
    up_props = scratch.cut(_properties_above(kb))
    below, above = restrictions(kb)
    raised = key_join(below, up_props, ["prop"]).select(
        "cls", F.col("super_prop").alias("prop"), "filler"
    )
    below = scratch.cut(below.unionByName(raised).dropDuplicates())
    above = scratch.cut(above)
    ups = scratch.cut(transitive_closure(told, "cls", "supclass"))
    up = ups.select(F.col("cls").alias("supclass"), F.col("supclass").alias("_up"))

    def with_supers(rows: DataFrame) -> DataFrame:
        higher = key_join(rows, up, ["supclass"]).select("cls", F.col("_up").alias("supclass"))
        return rows.unionByName(higher)

    names = [told.select("cls"), told.select(F.col("supclass").alias("cls"))]
    names += [t.select(c) for t in (below, above) for c in ("cls", F.col("filler").alias("cls"))]
    names += [pairs.select(F.col(c).alias("cls")) for c in ("c1", "c2", "dst")]
    names = union_all(names).filter(F.col("cls") != "").dropDuplicates()

    subs, links, reach = _Growing(scratch), _Growing(scratch), _Growing(scratch)
    subs.add([names.select("cls", F.col("cls").alias("supclass")), ups])
    derived = []
    anything = above.filter(F.col("filler") == OWL_THING).select("prop", F.col("cls").alias("supclass"))
    while subs.newest is not None or links.newest is not None:
        new_subs, new_links = subs.newest, links.newest
        # Who links to whom now, and what a link to whom gives.
        gained = []
        if new_subs is not None:
            of = below.select(F.col("cls").alias("supclass"), "prop", "filler")
            gained.append(key_join(new_subs, of, ["supclass"]).select("cls", "prop", "filler"))
        if new_links is not None and chains is not None:
            gained += _chained(links, new_links, chains, up_props)
        links.add(gained)
        if new_subs is not None:
            into = above.select(F.col("filler").alias("supclass"), "prop", F.col("cls").alias("dst"))
            into = key_join(new_subs, into, ["supclass"])
            reach.add([into.select(F.col("cls").alias("filler"), "prop", "dst")])
        else:
            reach.newest = None
        found = []
        if new_subs is not None:
            found.append(_both(subs, new_subs, pairs))
        if links.newest is not None:
            found.append(key_join(links.newest, anything, ["prop"]).select("cls", "supclass"))
            if reach.parts:
                found.append(_over(links.newest, reach.whole))
        if reach.newest is not None and links.parts:
            found.append(_over(links.whole, reach.newest))
        if not found:
            subs.newest = None
            continue
        fresh, rows = scratch.cut_rows(new_rows(union_all(found), subs.parts))
        if rows:
            derived.append(fresh)
            subs.add([with_supers(fresh)])
        else:
            subs.newest = None
    return union_all([told, *derived]).dropDuplicates()


def _both(subs: _Growing, newest: DataFrame, pairs: DataFrame) -> DataFrame:
    """Classes below both parts of an intersection, one of them newly so."""
    either = pairs.unionByName(
        pairs.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"), "dst")
    )
    half = key_join(newest, either.withColumnRenamed("c1", "supclass"), ["supclass"])
    half = half.select("cls", F.col("c2").alias("supclass"), "dst")
    return half.join(subs.whole, ["cls", "supclass"]).select("cls", F.col("dst").alias("supclass"))


def _over(links: DataFrame, reach: DataFrame) -> DataFrame:
    both = key_join(links, reach, ["prop", "filler"])
    return both.select("cls", F.col("dst").alias("supclass"))


def _chained(
    links: _Growing, newest: DataFrame, chains: DataFrame, up_props: DataFrame
) -> list[DataFrame]:
    """Links by chains of two, one of them new, and by the properties above the whole chain."""
    wider = key_join(chains.withColumnRenamed("whole", "prop"), up_props, ["prop"])
    chains = chains.unionByName(wider.select("first", "second", F.col("super_prop").alias("whole")))

    def joined(first: DataFrame, second: DataFrame) -> DataFrame:
        first = key_join(first.withColumnRenamed("prop", "first"), chains, ["first"])
        first = first.select("cls", F.col("filler").alias("_mid"), F.col("second").alias("prop"), "whole")
        second = second.withColumnRenamed("cls", "_mid")
        return key_join(first, second, ["_mid", "prop"]).select("cls", F.col("whole").alias("prop"), "filler")

    return [joined(newest, links.whole), joined(links.whole, newest)]

"""Hierarchies as told by the axioms: closures, direct parents, inherited ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontomill.kb import KnowledgeBase
from ontomill.operators.closure import Condensed, condense, transitive_closure
from ontomill.operators.completion import completed_steps
from ontomill.operators.joins import key_join, union_all
from ontomill.schema import OWL_NOTHING, OWL_THING
from ontomill.sources.scratch import Scratch


def told_superclasses(kb: KnowledgeBase) -> DataFrame:
    """``(cls, supclass)`` steps that single axioms state."""

    def step(table: str, below: str, above: str) -> DataFrame:
        return kb[table].select(F.col(below).alias("cls"), F.col(above).alias("supclass"))

    steps = union_all(
        [
            step("subclass_of_class", "cls", "supclass"),
            step("equivalent_to_class", "cls", "equiv"),
            step("equivalent_to_class", "equiv", "cls"),
            step("equivalent_to_intersection", "cls", "ind1"),
            step("equivalent_to_intersection", "cls", "ind2"),
            step("subclass_of_intersection", "cls", "ind1"),
            step("subclass_of_intersection", "cls", "ind2"),
            step("equivalent_to_union", "ind1", "cls"),
            step("equivalent_to_union", "ind2", "cls"),
        ]
    )
    return steps.filter((F.col("cls") != "") & (F.col("supclass") != ""))


# A class in a condensed hierarchy is its name behind a sign. The smallest member stands for a
# group of equal classes, so the signs make it a named one if there is any.
NAMED, END, UNNAMED = "0", "1", "2"


def _signed(name: str) -> Column:
    sign = F.when(F.col(name).startswith("_:"), UNNAMED)
    sign = sign.when(F.col(name).isin(OWL_THING, OWL_NOTHING), END).otherwise(NAMED)
    return F.concat(sign, F.col(name))


def condensed_hierarchy(kb: KnowledgeBase, steps: DataFrame | None = None) -> Condensed:
    """The classes with equal ones taken together, closed; by the told steps unless given.

    Its nodes are class names behind one of the signs ``NAMED``, ``END`` and ``UNNAMED``.
    """
    steps = told_superclasses(kb) if steps is None else steps
    return condense(steps.select(_signed("cls").alias("src"), _signed("supclass").alias("dst")))


def class_hierarchy_closure(kb: KnowledgeBase) -> DataFrame:
    """All ``(cls, supclass)`` between named classes that follow from the told steps."""
    closed = transitive_closure(told_superclasses(kb), "cls", "supclass")
    return _between_named(closed).filter(F.col("cls") != F.col("supclass"))


def _between_named(pairs: DataFrame) -> DataFrame:
    named = ~F.col("cls").startswith("_:") & ~F.col("supclass").startswith("_:")
    ends = (F.col("supclass") != OWL_THING) & (F.col("cls") != OWL_NOTHING)
    return pairs.filter(named & ends)


def direct_superclasses(kb: KnowledgeBase, graph: Condensed | None = None) -> DataFrame:
    """``(cls, supclass)`` with nothing strictly between the two, by the told steps or by those
    of ``graph``.

    Only steps can be direct. A step is not if another step from the same class leads to a
    class below the same superclass; that is looked up in the closure. Steps by way of
    unnamed classes are first followed to the next named ones.
    """
    graph = condensed_hierarchy(kb) if graph is None else graph
    from_class = ~F.col("src").startswith(UNNAMED) & (F.col("src") != END + OWL_NOTHING)
    to_class = ~F.col("dst").startswith(UNNAMED) & (F.col("dst") != END + OWL_THING)
    steps = graph.steps.filter(from_class)
    onward = graph.closed.select(F.col("src").alias("_mid"), F.col("dst").alias("_end"))
    around = key_join(steps.filter(~to_class).withColumnRenamed("dst", "_mid"), onward, ["_mid"])
    around = around.select("src", F.col("_end").alias("dst"))
    steps = steps.unionByName(around).filter(to_class).dropDuplicates()
    steps = Scratch(kb.spark).cut(steps)
    # src -> _mid and src -> dst are steps: is _mid below dst?
    others = key_join(steps.withColumnRenamed("dst", "_mid"), steps, ["src"])
    others = others.filter(F.col("_mid") != F.col("dst"))
    below = graph.closed.select(F.col("src").alias("_mid"), "dst")
    over = others.join(below, ["_mid", "dst"], "left_semi").select("src", "dst")
    direct = graph.members(steps.join(over, ["src", "dst"], "left_anti"))
    names = [F.substring(end, 2, 1 << 30).alias(n) for end, n in (("src", "cls"), ("dst", "supclass"))]
    return _between_named(direct.select(*names))


def inferred_superclasses(kb: KnowledgeBase, chains: DataFrame | None = None) -> DataFrame:
    """``direct_superclasses`` of all that follows, existential restrictions, intersections
    and property ``chains`` included; see ``completion.completed_steps``."""
    steps = completed_steps(kb, told_superclasses(kb), chains)
    return direct_superclasses(kb, condensed_hierarchy(kb, steps))


def inferred_subclasses(kb: KnowledgeBase, direct: DataFrame | None = None) -> DataFrame:
    """subclass_of_class rows of the direct hierarchy that are not asserted."""
    direct = inferred_superclasses(kb) if direct is None else direct
    return direct.join(kb["subclass_of_class"], ["cls", "supclass"], "left_anti")


def super_class_of(kb: KnowledgeBase, direct: DataFrame | None = None) -> DataFrame:
    """The direct hierarchy seen from above, as ``(cls, subclass)``."""
    direct = inferred_superclasses(kb) if direct is None else direct
    return direct.select(F.col("supclass").alias("cls"), F.col("cls").alias("subclass"))


def inherit_domain(kb: KnowledgeBase, closed: DataFrame | None = None) -> DataFrame:
    """op_domain with the domains of all super-properties."""
    return _inherit(kb, "op_domain", "domain", closed)


def inherit_range(kb: KnowledgeBase, closed: DataFrame | None = None) -> DataFrame:
    """op_range with the ranges of all super-properties."""
    return _inherit(kb, "op_range", "range", closed)


def property_closure(kb: KnowledgeBase) -> DataFrame:
    return transitive_closure(kb["sub_property_of"], "prop", "super_prop")


def _inherit(kb: KnowledgeBase, table: str, side: str, closed: DataFrame | None) -> DataFrame:
    closed = property_closure(kb) if closed is None else closed
    above = closed.select(F.col("prop").alias("below"), F.col("super_prop").alias("property"))
    inherited = key_join(above, kb[table], ["property"]).select(
        side, F.col("below").alias("property")
    )
    return kb[table].unionByName(inherited).dropDuplicates()

"""Edge tables: what each rule asks of the ontology, before any individual is read.

Every rule is "facts of this shape give facts of that shape, as the axioms say".
The axiom part is a join over axiom tables only. It is worked out here into one
small table per rule; the rules then apply it to the facts (``kernels``). Rules
that share a shape share the edge columns:

* ``class_edges``     ``(src, dst)``: members of src are members of dst
* ``pair_edges``      ``(c1, c2, dst)``: members of both c1 and c2 are members of dst
* ``end_edges``       ``(prop, side, dst)``: the ``side`` end of a prop link is in dst
* ``link_edges``      ``(src, flip, dst)``: a src link is a dst link, reversed if flip
* ``guarded_edges``   ``(cls, prop, side, dst)``: when the ``side`` end of a prop link
  is in cls, the other end is in dst
* ``unique_edges``    ``(prop, side)``: the ``side`` end of a prop link has one value
* ``guarded_unique_edges`` ``(cls, prop)``: as above, for subjects in cls only
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.kb import KnowledgeBase
from ontomill.schema import OWL_THING

Edges = Callable[[KnowledgeBase], DataFrame]


def _members_of_list(df: DataFrame) -> DataFrame:
    """Rows ``(cls, operand)`` of a two-operand table, without blank operands."""
    pair = df.select("cls", F.explode(F.array("ind1", "ind2")).alias("operand"))
    return pair.filter(F.col("operand") != "")


# ---- class -> class -------------------------------------------------------------


def double_negation(kb: KnowledgeBase) -> DataFrame:
    inner = kb["complement_of"].select(F.col("key").alias("mid"), F.col("complement").alias("dst"))
    outer = kb["complement_of"].select(F.col("key").alias("src"), F.col("complement").alias("mid"))
    return outer.join(inner, "mid").select("src", "dst")


def contraposition(kb: KnowledgeBase) -> DataFrame:
    sub = kb["subclass_of_class"]
    not_sub = kb["complement_of"].select(
        F.col("complement").alias("cls"), F.col("key").alias("dst")
    )
    not_super = kb["complement_of"].select(
        F.col("complement").alias("supclass"), F.col("key").alias("src")
    )
    return sub.join(not_sub, "cls").join(not_super, "supclass").select("src", "dst")


def disjointness(kb: KnowledgeBase) -> DataFrame:
    """Pairs as stated; of a list of classes, only those with a negation meet the others."""
    negated = kb["complement_of"].select(F.col("key").alias("ind1"), F.col("complement").alias("dst"))
    pairs = kb["disjoint_with"].join(negated, "ind1").select(F.col("cls").alias("src"), "dst")
    members = kb["disjoint_members"]
    against = members.select("axiom", F.col("cls").alias("ind1")).join(negated, "ind1")
    listed = members.join(against, "axiom").filter(F.col("cls") != F.col("ind1"))
    return pairs.unionByName(listed.select(F.col("cls").alias("src"), "dst"))


def subclass(kb: KnowledgeBase) -> DataFrame:
    return kb["subclass_of_class"].select(F.col("cls").alias("src"), F.col("supclass").alias("dst"))


def subclass_intersection(kb: KnowledgeBase) -> DataFrame:
    operands = _members_of_list(kb["subclass_of_intersection"])
    return operands.select(F.col("cls").alias("src"), F.col("operand").alias("dst"))


def equivalent_class(kb: KnowledgeBase) -> DataFrame:
    return kb["equivalent_to_class"].select(F.col("cls").alias("src"), F.col("equiv").alias("dst"))


def equivalent_intersection(kb: KnowledgeBase) -> DataFrame:
    operands = _members_of_list(kb["equivalent_to_intersection"])
    return operands.select(F.col("cls").alias("src"), F.col("operand").alias("dst"))


def equivalent_union(kb: KnowledgeBase) -> DataFrame:
    operands = _members_of_list(kb["equivalent_to_union"])
    return operands.select(F.col("operand").alias("src"), F.col("cls").alias("dst"))


# ---- class and class -> class ----------------------------------------------------


def _remaining_operand(union: DataFrame, complement: DataFrame) -> DataFrame:
    """In the union but outside one operand leaves the other operand."""
    outside = complement.select(F.col("complement").alias("gone"), F.col("key").alias("c2"))
    cases = union.select("cls", F.col("ind1").alias("gone"), F.col("ind2").alias("dst")).unionByName(
        union.select("cls", F.col("ind2").alias("gone"), F.col("ind1").alias("dst"))
    )
    return cases.join(outside, "gone").select(F.col("cls").alias("c1"), "c2", "dst")


def subclass_union(kb: KnowledgeBase) -> DataFrame:
    return _remaining_operand(kb["subclass_of_union"], kb["complement_of"])


def equivalent_union_operand(kb: KnowledgeBase) -> DataFrame:
    return _remaining_operand(kb["equivalent_to_union"], kb["complement_of"])


def equivalent_intersection_whole(kb: KnowledgeBase) -> DataFrame:
    both = kb["equivalent_to_intersection"].filter((F.col("ind1") != "") & (F.col("ind2") != ""))
    return both.select(
        F.col("ind1").alias("c1"), F.col("ind2").alias("c2"), F.col("cls").alias("dst")
    )


# ---- property -> class -------------------------------------------------------------


def property_domain(kb: KnowledgeBase) -> DataFrame:
    return kb["op_domain"].select(
        F.col("property").alias("prop"), F.lit("domain").alias("side"), F.col("domain").alias("dst")
    )


def property_range(kb: KnowledgeBase) -> DataFrame:
    return kb["op_range"].select(
        F.col("property").alias("prop"), F.lit("range").alias("side"), F.col("range").alias("dst")
    )


def _one_of_anything(cardinality: DataFrame) -> DataFrame:
    return cardinality.filter((F.col("card") == 1) & (F.col("clss") == OWL_THING))


def min_cardinality(kb: KnowledgeBase) -> DataFrame:
    return _one_of_anything(kb["equivalent_to_min_cardinality"]).select(
        "prop", F.lit("domain").alias("side"), F.col("cls").alias("dst")
    )


# ---- property -> property ----------------------------------------------------------


def inverse_property(kb: KnowledgeBase) -> DataFrame:
    return kb["inverse_of"].select(
        F.col("prop").alias("src"), F.lit(True).alias("flip"), F.col("inverse").alias("dst")
    )


def sub_property(kb: KnowledgeBase) -> DataFrame:
    return kb["sub_property_of"].select(
        F.col("prop").alias("src"), F.lit(False).alias("flip"), F.col("super_prop").alias("dst")
    )


def equivalent_property(kb: KnowledgeBase) -> DataFrame:
    return kb["equivalent_property"].select(
        F.col("cls").alias("src"), F.lit(False).alias("flip"), F.col("equiv").alias("dst")
    )


# ---- class and property -> class -----------------------------------------------------


def _value_in_range(restriction: DataFrame) -> DataFrame:
    return restriction.select(
        "cls", "prop", F.lit("domain").alias("side"), F.col("range").alias("dst")
    )


def subclass_all(kb: KnowledgeBase) -> DataFrame:
    return _value_in_range(kb["subclass_of_all"])


def equivalent_all(kb: KnowledgeBase) -> DataFrame:
    return _value_in_range(kb["equivalent_to_all"])


def subclass_some_functional(kb: KnowledgeBase) -> DataFrame:
    some = kb["subclass_of_some"].join(kb["functional_property"], "prop", "left_semi")
    return _value_in_range(some)


def equivalent_some_functional(kb: KnowledgeBase) -> DataFrame:
    some = kb["equivalent_to_some"].join(kb["functional_property"], "prop", "left_semi")
    return _value_in_range(some)


def equivalent_some(kb: KnowledgeBase) -> DataFrame:
    return kb["equivalent_to_some"].select(
        F.col("range").alias("cls"), "prop", F.lit("range").alias("side"), F.col("cls").alias("dst")
    )


# ---- single-valued properties -----------------------------------------------------------


def functional(kb: KnowledgeBase) -> DataFrame:
    return kb["functional_property"].select("prop", F.lit("domain").alias("side"))


def inverse_functional(kb: KnowledgeBase) -> DataFrame:
    return kb["inverse_functional_property"].select("prop", F.lit("range").alias("side"))


def max_cardinality(kb: KnowledgeBase) -> DataFrame:
    return _one_of_anything(kb["equivalent_to_max_cardinality"]).select("cls", "prop")

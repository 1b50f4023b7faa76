"""The inference rules, each a function of a knowledge base.

A rule returns the distinct facts that one application of it derives, known or
not, in the columns of the fact table it feeds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.kb import KnowledgeBase
from ontomill.operators import closure, edges, kernels

CLASS, PROP, SAME = "class_individuals", "prop_individuals", "same_as"

#: Edges of at most this many rows narrow the facts they are applied to by literal values.
MOST_KEYS = 500


@dataclass(frozen=True)
class Rule:
    """One rule: its name, the table it feeds, the axiom tables it needs, its body."""

    name: str
    feeds: str
    axioms: tuple[str, ...]
    body: Callable[[KnowledgeBase], DataFrame]

    def __call__(self, kb: KnowledgeBase) -> DataFrame:
        return self.body(kb).dropDuplicates()


RULES: dict[str, Rule] = {}


def _rule(name: str, feeds: str, axioms: tuple[str, ...], body) -> None:
    RULES[name] = Rule(name, feeds, axioms, body)


def _among(facts: DataFrame, column: str, edges: DataFrame, *names: str) -> DataFrame:
    """The facts that some edge may apply to, by literal keys if these are few: the planner
    then leaves out what cannot hold them, and the scans skip row groups."""
    found = edges.select(*names).limit(MOST_KEYS + 1).collect()
    if len(found) > MOST_KEYS:
        return facts
    return facts.filter(F.col(column).isin(sorted({row[name] for row in found for name in names})))


def _class_rule(name: str, axioms: tuple[str, ...], make: edges.Edges) -> None:
    def body(kb: KnowledgeBase) -> DataFrame:
        edge = make(kb)
        return kernels.class_to_class(_among(kb[CLASS], "cls", edge, "src"), edge)

    _rule(name, CLASS, axioms, body)


def _pair_rule(name: str, axioms: tuple[str, ...], make: edges.Edges) -> None:
    def body(kb: KnowledgeBase) -> DataFrame:
        edge = make(kb)
        second = _among(kb[CLASS], "cls", edge, "c2")
        return kernels.class_pair_to_class(_among(kb[CLASS], "cls", edge, "c1"), edge, second)

    _rule(name, CLASS, axioms, body)


def _end_rule(name: str, axioms: tuple[str, ...], make: edges.Edges) -> None:
    def body(kb: KnowledgeBase) -> DataFrame:
        edge = make(kb)
        return kernels.property_to_class(_among(kb[PROP], "prop", edge, "prop"), edge)

    _rule(name, CLASS, axioms, body)


def _link_rule(name: str, axioms: tuple[str, ...], make: edges.Edges) -> None:
    def body(kb: KnowledgeBase) -> DataFrame:
        edge = make(kb)
        return kernels.property_to_property(_among(kb[PROP], "prop", edge, "src"), edge)

    _rule(name, PROP, axioms, body)


def _guarded_rule(name: str, axioms: tuple[str, ...], make: edges.Edges) -> None:
    def body(kb: KnowledgeBase) -> DataFrame:
        edge = make(kb)
        members = _among(kb[CLASS], "cls", edge, "cls")
        return kernels.guarded_property_to_class(members, edge, _among(kb[PROP], "prop", edge, "prop"))

    _rule(name, CLASS, axioms, body)


def single_valued_ends(kb: KnowledgeBase, which: str) -> DataFrame:
    """The ends whose values are equal by the named rule, as (prop, side, node, other)."""
    if which == "equivalent_to_max_cardinality":
        edge = edges.max_cardinality(kb)
        members = _among(kb[CLASS], "cls", edge, "cls")
        return kernels.guarded_ends(members, edge, _among(kb[PROP], "prop", edge, "prop"))
    make = edges.functional if which == "functional_property" else edges.inverse_functional
    edge = make(kb)
    return kernels.link_ends(_among(kb[PROP], "prop", edge, "prop"), edge)


SINGLE_VALUE_RULES = (
    "equivalent_to_max_cardinality",
    "functional_property",
    "inverse_functional_property",
)


def _unique_rule(name: str, axioms: tuple[str, ...]) -> None:
    _rule(name, SAME, axioms, lambda kb: kernels.same_values(single_valued_ends(kb, name)))


def all_same_pairs(kb: KnowledgeBase, which: str) -> DataFrame:
    """Every ordered pair that the named single-value rule equates, written out.

    Quadratic in the size of a group of equal values; the rule itself returns the
    links to the smallest value instead.
    """
    return kernels.same_pairs(single_valued_ends(kb, which)).dropDuplicates()


# Order of the rules within a stage, then the closure rule.
_class_rule("complement_of", ("complement_of",), edges.double_negation)
_class_rule(
    "complement_of_second", ("complement_of", "subclass_of_class"), edges.contraposition
)
_class_rule("disjoint_with", ("complement_of",), edges.disjointness)
_end_rule("object_property_domain", ("op_domain",), edges.property_domain)
_link_rule("object_property_inverse_of", ("inverse_of",), edges.inverse_property)
_end_rule("object_property_range", ("op_range",), edges.property_range)
_link_rule("object_property_sub_property_of", ("sub_property_of",), edges.sub_property)
_class_rule("subclass_of_class", ("subclass_of_class",), edges.subclass)
_guarded_rule("subclass_of_all", ("subclass_of_all",), edges.subclass_all)
_class_rule(
    "subclass_of_intersection", ("subclass_of_intersection",), edges.subclass_intersection
)
_guarded_rule(
    "subclass_of_some_second",
    ("subclass_of_some", "functional_property"),
    edges.subclass_some_functional,
)
_pair_rule(
    "subclass_of_union_second", ("subclass_of_union", "complement_of"), edges.subclass_union
)
_guarded_rule("equivalent_to_all", ("equivalent_to_all",), edges.equivalent_all)
_class_rule("equivalent_to_class", ("equivalent_to_class",), edges.equivalent_class)
_class_rule(
    "equivalent_to_intersection", ("equivalent_to_intersection",), edges.equivalent_intersection
)
_pair_rule(
    "equivalent_to_intersection_second",
    ("equivalent_to_intersection",),
    edges.equivalent_intersection_whole,
)
_guarded_rule("equivalent_to_some", ("equivalent_to_some",), edges.equivalent_some)
_guarded_rule(
    "equivalent_to_some_second",
    ("equivalent_to_some", "functional_property"),
    edges.equivalent_some_functional,
)
_class_rule("equivalent_to_union", ("equivalent_to_union",), edges.equivalent_union)
_pair_rule(
    "equivalent_to_union_second",
    ("equivalent_to_union", "complement_of"),
    edges.equivalent_union_operand,
)
_unique_rule("equivalent_to_max_cardinality", ("equivalent_to_max_cardinality",))
_end_rule(
    "equivalent_to_min_cardinality", ("equivalent_to_min_cardinality",), edges.min_cardinality
)
_unique_rule("functional_property", ("functional_property",))
_unique_rule("inverse_functional_property", ("inverse_functional_property",))
_link_rule(
    "object_property_equivalent_to_class", ("equivalent_property",), edges.equivalent_property
)
_rule("same_as_class_individual", CLASS, (), lambda kb: kernels.same_to_class(kb[CLASS], kb[SAME]))
_rule("same_as_prop_individual", PROP, (), lambda kb: kernels.same_to_property(kb[PROP], kb[SAME]))
_rule("same_as_transitive_closure", SAME, (), lambda kb: closure.same_as_closure(kb[SAME]))

"""One fixture per rule, and cases where a shortcut would lose or add facts."""

import pytest
from conftest import rows

from ontomill.kb import KnowledgeBase
from ontomill.operators.rules import RULES, SINGLE_VALUE_RULES, all_same_pairs
from ontomill.schema import OWL_THING

A = [("#A", "#a")]
P_AB = [("#P", "#a", "#b")]
FIXTURES = {
    "complement_of_second": (
        dict(
            class_individuals=[("#J", "#a")],
            complement_of=[("#I", "#A"), ("#J", "#B")],
            subclass_of_class=[("#A", "#B"), ("#J", "#I")],
        ),
        {("#I", "#a")},
    ),
    "complement_of": (
        dict(class_individuals=[("#E", "#x")], complement_of=[("#C", "#D"), ("#E", "#C")]),
        {("#D", "#x")},
    ),
    "disjoint_with": (
        dict(class_individuals=A, complement_of=[("#B", "#I")], disjoint_with=[("#A", "#B")]),
        {("#I", "#a")},
    ),
    "equivalent_to_all": (
        dict(class_individuals=A, prop_individuals=P_AB, equivalent_to_all=[("#A", "#P", "#C")]),
        {("#C", "#b")},
    ),
    "equivalent_to_class": (
        dict(class_individuals=A, equivalent_to_class=[("#A", "#B")]),
        {("#B", "#a")},
    ),
    "equivalent_to_intersection_second": (
        dict(
            class_individuals=[("#A", "#a"), ("#B", "#a")],
            equivalent_to_intersection=[("#C", "#A", "#B")],
        ),
        {("#C", "#a")},
    ),
    "equivalent_to_intersection": (
        dict(class_individuals=A, equivalent_to_intersection=[("#A", "#B", "#C")]),
        {("#B", "#a"), ("#C", "#a")},
    ),
    "equivalent_to_max_cardinality": (
        dict(
            class_individuals=A,
            equivalent_to_max_cardinality=[("#A", "#P", 1, OWL_THING)],
            prop_individuals=[("#P", "#a", "#b1"), ("#P", "#a", "#b2")],
        ),
        {("#b1", "#b2"), ("#b2", "#b1")},
    ),
    "equivalent_to_min_cardinality": (
        dict(
            equivalent_to_min_cardinality=[("#A", "#P", 1, OWL_THING)], prop_individuals=P_AB
        ),
        {("#A", "#a")},
    ),
    "equivalent_to_some_second": (
        dict(
            class_individuals=[("#B", "#x")],
            prop_individuals=[("#Q", "#x", "#y")],
            equivalent_to_some=[("#B", "#Q", "#D")],
            functional_property=[("#Q",)],
        ),
        {("#D", "#y")},
    ),
    "equivalent_to_some": (
        dict(
            class_individuals=[("#C", "#b")],
            prop_individuals=P_AB,
            equivalent_to_some=[("#A", "#P", "#C")],
        ),
        {("#A", "#a")},
    ),
    "equivalent_to_union_second": (
        dict(
            equivalent_to_union=[("#G", "#E", "#F")],
            complement_of=[("#J", "#F")],
            class_individuals=[("#J", "#y"), ("#G", "#y")],
        ),
        {("#E", "#y")},
    ),
    "equivalent_to_union": (
        dict(
            equivalent_to_union=[("#A", "#C", "#D")],
            class_individuals=[("#C", "#a"), ("#D", "#b")],
        ),
        {("#A", "#a"), ("#A", "#b")},
    ),
    "functional_property": (
        dict(
            functional_property=[("#P",)],
            prop_individuals=[("#P", "#a", "#b1"), ("#P", "#a", "#b2"), ("#P", "#b", "#b3")],
        ),
        {("#b1", "#b2"), ("#b2", "#b1")},
    ),
    "inverse_functional_property": (
        dict(
            inverse_functional_property=[("#P",)],
            prop_individuals=[("#P", "#a1", "#b"), ("#P", "#a2", "#b")],
        ),
        {("#a1", "#a2"), ("#a2", "#a1")},
    ),
    "object_property_domain": (
        dict(op_domain=[("#A", "#P")], prop_individuals=[("#P", "#a", "#c")]),
        {("#A", "#a")},
    ),
    "object_property_equivalent_to_class": (
        dict(equivalent_property=[("#p1", "#p2")], prop_individuals=[("#p1", "#a", "#b")]),
        {("#p2", "#a", "#b")},
    ),
    "object_property_inverse_of": (
        dict(inverse_of=[("#P", "#Q")], prop_individuals=[("#P", "#x", "#y")]),
        {("#Q", "#y", "#x")},
    ),
    "object_property_range": (
        dict(op_range=[("#B", "#P")], prop_individuals=P_AB),
        {("#B", "#b")},
    ),
    "object_property_sub_property_of": (
        dict(sub_property_of=[("#P", "#Q")], prop_individuals=[("#P", "#x", "#y")]),
        {("#Q", "#x", "#y")},
    ),
    "same_as_class_individual": (
        dict(same_as=[("#a", "#b")], class_individuals=A),
        {("#A", "#b")},
    ),
    "same_as_prop_individual": (
        dict(same_as=[("#a", "#b")], prop_individuals=[("#P", "#a", "#c")]),
        {("#P", "#b", "#c")},
    ),
    "same_as_transitive_closure": (
        dict(same_as=[("#a", "#b"), ("#b", "#c"), ("#c", "#d")]),
        {("#a", "#b"), ("#a", "#c"), ("#a", "#d"), ("#b", "#c"), ("#b", "#d"), ("#c", "#d")},
    ),
    "subclass_of_all": (
        dict(
            subclass_of_all=[("#D", "#Q", "#E")],
            class_individuals=[("#D", "#x")],
            prop_individuals=[("#Q", "#x", "#y")],
        ),
        {("#E", "#y")},
    ),
    "subclass_of_class": (
        dict(subclass_of_class=[("#A", "#B")], class_individuals=A),
        {("#B", "#a")},
    ),
    "subclass_of_intersection": (
        dict(subclass_of_intersection=[("#A", "#B", "#C")], class_individuals=A),
        {("#B", "#a"), ("#C", "#a")},
    ),
    "subclass_of_some_second": (
        dict(
            class_individuals=[("#B", "#x")],
            prop_individuals=[("#Q", "#x", "#y")],
            subclass_of_some=[("#B", "#Q", "#D")],
            functional_property=[("#Q",)],
        ),
        {("#D", "#y")},
    ),
    "subclass_of_union_second": (
        dict(
            subclass_of_union=[("#G", "#E", "#F")],
            complement_of=[("#J", "#F")],
            class_individuals=[("#J", "#y"), ("#G", "#y")],
        ),
        {("#E", "#y")},
    ),
}


def test_every_rule_has_a_fixture():
    assert set(FIXTURES) == set(RULES)


@pytest.mark.parametrize("name", sorted(FIXTURES))
def test_rule(spark, name):
    tables, expected = FIXTURES[name]
    assert rows(RULES[name](KnowledgeBase.from_rows(spark, **tables))) == expected


def test_all_restrictions_and_individuals_of_a_property_count(spark):
    kb = KnowledgeBase.from_rows(
        spark,
        class_individuals=[("#C", "#b"), ("#C", "#d"), ("#C2", "#b")],
        prop_individuals=[("#P", "#a", "#b"), ("#P", "#c", "#d")],
        equivalent_to_some=[("#A", "#P", "#C"), ("#A2", "#P", "#C2")],
    )
    assert rows(RULES["equivalent_to_some"](kb)) == {("#A", "#a"), ("#A", "#c"), ("#A2", "#a")}


def test_all_inverses_of_a_property_count(spark):
    kb = KnowledgeBase.from_rows(
        spark, inverse_of=[("#P", "#Q"), ("#P", "#R")], prop_individuals=P_AB
    )
    derived = rows(RULES["object_property_inverse_of"](kb))
    assert derived == {("#Q", "#b", "#a"), ("#R", "#b", "#a")}


def test_values_of_different_subjects_stay_apart(spark):
    kb = KnowledgeBase.from_rows(
        spark,
        class_individuals=[("#A", "#a"), ("#A", "#c")],
        equivalent_to_max_cardinality=[("#A", "#P", 1, OWL_THING), ("#A", "#Q", 2, OWL_THING)],
        prop_individuals=[
            ("#P", "#a", "#b"),
            ("#P", "#c", "#d"),
            ("#P", "#x", "#b1"),
            ("#P", "#x", "#b2"),
            ("#Q", "#a", "#b"),
            ("#Q", "#a", "#d"),
        ],
    )
    assert rows(RULES["equivalent_to_max_cardinality"](kb)) == set()


def test_an_intersection_with_itself_and_with_a_blank_operand(spark):
    kb = KnowledgeBase.from_rows(
        spark,
        class_individuals=[("#A", "#a"), ("#C", "#c")],
        equivalent_to_intersection=[("#B", "#A", "#A"), ("#C", "#D", "")],
    )
    assert rows(RULES["equivalent_to_intersection_second"](kb)) == {("#B", "#a")}
    assert rows(RULES["equivalent_to_intersection"](kb)) == {("#D", "#c")}


@pytest.mark.parametrize("name", SINGLE_VALUE_RULES)
def test_links_and_pairs_of_equal_values(spark, name):
    links = [("#P", "#a", f"#b{i}") for i in range(5)]
    kb = KnowledgeBase.from_rows(
        spark,
        class_individuals=A,
        equivalent_to_max_cardinality=[("#A", "#P", 1, OWL_THING)],
        functional_property=[("#P",)],
        inverse_functional_property=[("#P",)],
        prop_individuals=links
        if name != "inverse_functional_property"
        else [(p, r, d) for p, d, r in links],
    )
    values = {f"#b{i}" for i in range(5)}
    star = {(v, "#b0") for v in values - {"#b0"}} | {("#b0", v) for v in values - {"#b0"}}
    assert rows(RULES[name](kb)) == star
    assert rows(all_same_pairs(kb, name)) == {(v, w) for v in values for w in values if v != w}

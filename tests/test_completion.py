"""Completion over restrictions and chains against a direct computation."""

import random

import pytest
from conftest import rows

from ontomill.kb import KnowledgeBase
from ontomill.operators import hierarchy
from ontomill.operators.closure import transitive_closure
from ontomill.operators.completion import completed_steps
from ontomill.schema import OWL_THING


def _sample(seed):
    rnd = random.Random(seed)
    classes, props = [f"C{i}" for i in range(8)], [f"P{i}" for i in range(3)]

    def some(n, *pools):
        return sorted({tuple(rnd.choice(pool) for pool in pools) for _ in range(n)})

    tables = dict(
        subclass_of_class=some(4, classes, classes),
        equivalent_to_class=some(1, classes, classes),
        subclass_of_some=some(4, classes, props, classes),
        equivalent_to_some=some(3, classes, props, classes),
        equivalent_to_intersection=some(2, classes, classes, classes),
        subclass_of_min_cardinality=[(c, p, 2, d) for c, p, d in some(1, classes, props, classes)],
        equivalent_to_min_cardinality=[(c, p, 1, d) for c, p, d in some(1, classes, props, classes)],
        sub_property_of=some(2, props, props),
        equivalent_property=some(1, props, props),
        op_domain=some(1, classes, props),
    )
    return tables, some(2, props, props, props)


def _brute(t, chains):
    """All (cls, supclass) and links over Python sets, by the four rules."""
    up = t["subclass_of_class"] + [p for a, b in t["equivalent_to_class"] for p in ((a, b), (b, a))]
    up += [(c, d) for c, a, b in t["equivalent_to_intersection"] for d in (a, b)]
    below = t["subclass_of_some"] + t["equivalent_to_some"]
    below += [(c, p, d) for c, p, n, d in t["subclass_of_min_cardinality"] + t["equivalent_to_min_cardinality"]]
    above = t["equivalent_to_some"] + [(c, p, d) for c, p, _, d in t["equivalent_to_min_cardinality"]]
    above = above + [(c, p, OWL_THING) for c, p in t["op_domain"]]
    higher = t["sub_property_of"] + [p for a, b in t["equivalent_property"] for p in ((a, b), (b, a))]
    names = {f"C{i}" for i in range(8)}
    subs, links = {(c, c) for c in names}, set()
    while True:
        s = {(a, c) for a, b in subs for b2, c in up if b == b2}
        s |= {
            (a, c)
            for a in names
            for c, x, y in t["equivalent_to_intersection"]
            if (a, x) in subs and (a, y) in subs
        }
        s |= {
            (a, d)
            for a, r, b in links
            for d, r2, c in above
            if r == r2 and (c == OWL_THING or (b, c) in subs)
        }
        k = {(a, r, c) for a, b in subs for b2, r, c in below if b == b2}
        k |= {(a, s2, b) for a, r, b in links for r2, s2 in higher if r == r2}
        k |= {
            (a, w, c)
            for a, r, b in links
            for b2, q, c in links
            for f, g, w in chains
            if b == b2 and (r, q) == (f, g)
        }
        if s <= subs and k <= links:
            return {(a, b) for a, b in subs if a != b}
        subs, links = subs | s, links | k


@pytest.mark.parametrize("seed", range(2))
def test_completion_equals_direct_computation(spark, seed):
    tables, chains = _sample(seed)
    kb = KnowledgeBase.from_rows(spark, **tables)
    chained = spark.createDataFrame(chains, "first string, second string, whole string")
    steps = completed_steps(kb, hierarchy.told_superclasses(kb), chained)
    closed = rows(transitive_closure(steps, "cls", "supclass"))
    want = _brute(tables, chains)
    assert {(a, b) for a, b in closed if a != b} == want
    if seed == 0:
        strict = {(a, b) for a, b in want if (b, a) not in want}
        direct = {(a, c) for a, c in strict if not any((a, b) in strict and (b, c) in strict for b, _ in strict)}
        assert rows(hierarchy.inferred_superclasses(kb, chained)) == direct


def test_a_superclass_through_a_restriction(spark):
    kb = KnowledgeBase.from_rows(
        spark,
        subclass_of_some=[("A", "r", "B")],
        subclass_of_class=[("B", "C"), ("C", "E")],
        equivalent_to_some=[("D", "r", "E")],
    )
    assert rows(hierarchy.inferred_subclasses(kb)) == {("A", "D")}
    told = KnowledgeBase.from_rows(spark, subclass_of_class=[("A", "B"), ("B", "C"), ("A", "C")])
    assert rows(hierarchy.inferred_superclasses(told)) == {("A", "B"), ("B", "C")}
    assert rows(hierarchy.inferred_subclasses(told)) == set()


def test_direct_steps_look_the_closure_up_once(spark):
    steps = [("A", "B"), ("B", "C"), ("A", "C"), ("C", "_:x"), ("_:x", "D")]
    kb = KnowledgeBase.from_rows(spark, subclass_of_class=steps)
    graph = hierarchy.condensed_hierarchy(kb)
    direct = hierarchy.direct_superclasses(kb, graph)
    folder = graph.closed.inputFiles()[0].rsplit("/", 1)[0]
    plan = direct._jdf.queryExecution().executedPlan().toString()  # before it is adapted
    assert plan.count(folder[-40:]) == 1
    assert rows(direct) == {("A", "B"), ("B", "C"), ("C", "D")}

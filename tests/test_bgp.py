"""Pattern queries against nested loops over the same facts."""

import itertools
import random

import pytest
from conftest import row_list

from ontomill.kb import KnowledgeBase
from ontomill.operators.bgp import Link, Type, Var, asked_of, bgp
from ontomill.operators.stats import class_counts, property_counts, same_as_counts
from ontomill.plans.fixpoint import materialise

X, Y, Z, W = (Var(n) for n in "xyzw")
RND = random.Random(5)
NODES = [f"n{i}" for i in range(6)]
CI = sorted({(RND.choice("AB"), RND.choice(NODES)) for _ in range(7)})
PI = sorted({(RND.choice("pq"), RND.choice(NODES), RND.choice(NODES)) for _ in range(22)})


def brute(patterns, select):
    names = sorted({t.name for p in patterns for t in vars(p).values() if isinstance(t, Var)})
    found = set()
    for values in itertools.product(NODES, repeat=len(names)):
        at = dict(zip(names, values, strict=True))

        def val(t, at=at):
            return at[t.name] if isinstance(t, Var) else t

        if all(
            (p.cls, val(p.member)) in CI
            if isinstance(p, Type)
            else (p.prop, val(p.subject), val(p.object)) in PI
            for p in patterns
        ):
            found.add(tuple(at[v.name] for v in select))
    return sorted(found)


QUERIES = [
    ([Type(X, "A")], [X]),
    ([Type(X, "A"), Link(X, "p", "n1")], [X]),
    ([Link("n1", "q", Y), Type(Y, "B")], [Y]),
    ([Type(X, "A"), Link(X, "p", Y), Type(Y, "B"), Link(Y, "q", Z)], [X]),
    ([Link(X, "p", Y), Link(Y, "q", Z), Link(Z, "p", W)], [X]),
    ([Link(X, "p", Y), Link(Y, "q", Z)], [X, Z]),
    ([Link(X, "p", Y), Link(Y, "q", Z), Link(Z, "p", X)], [X]),
    ([Link(X, "p", Y), Link(Y, "p", Z), Link(Z, "q", X)], [X, Y, Z]),
    ([Link(X, "p", X), Link(X, "q", Y)], [Y]),
    ([Link(X, "p", Y), Link(X, "q", Y)], [Y]),
]


@pytest.mark.parametrize("number", range(len(QUERIES)))
def test_patterns(spark, number):
    patterns, select = QUERIES[number]
    kb = KnowledgeBase.from_rows(spark, class_individuals=CI, prop_individuals=PI)
    assert row_list(bgp(kb, patterns, select)) == brute(patterns, select)


def test_queries_that_make_no_sense(spark):
    kb = KnowledgeBase.from_rows(spark, class_individuals=CI, prop_individuals=PI)
    with pytest.raises(ValueError):
        bgp(kb, [Type(X, "A"), Type(Y, "B")], [X, Y])
    with pytest.raises(ValueError):
        bgp(kb, [Type(X, "A")], [Z])
    with pytest.raises(ValueError):
        bgp(kb, [Type(X, "A"), Type("n1", "B")], [X])


def test_counts(spark):
    kb = KnowledgeBase.from_rows(
        spark,
        class_individuals=[("A", "x"), ("A", "y"), ("A", "y"), ("B", "x")],
        prop_individuals=[("p", "x", "y"), ("p", "x", "z")],
        same_as=[("x", "y"), ("y", "x"), ("x", "z")],
    )
    assert row_list(class_counts(kb)) == [("A", 2), ("B", 1)]
    assert row_list(property_counts(kb)) == [("p", 2)]
    assert row_list(same_as_counts(kb)) == [("x", 2), ("y", 1)]


def test_patterns_name_what_is_wanted(spark):
    patterns = [Type(X, "A"), Link(X, "p", Y), Link(Y, "q", Z), Type(Y, "B")]
    asked = asked_of(patterns)
    assert asked == {"class_individuals": {"A", "B"}, "prop_individuals": {"p", "q"}}
    assert asked_of(patterns[:1]) == {"class_individuals": {"A"}}
    kb = KnowledgeBase.from_rows(
        spark, class_individuals=CI, prop_individuals=PI, subclass_of_class=[("A", "B")],
        sub_property_of=[("q", "p")], op_domain=[("A", "q")],
    )
    part, whole = materialise(kb, wanted=asked).kb, materialise(kb).kb
    assert row_list(bgp(part, patterns, [X])) == row_list(bgp(whole, patterns, [X]))

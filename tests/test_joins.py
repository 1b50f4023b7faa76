"""Joins, insert-if-new, closures and ordinals."""

import itertools
import random

import pytest
from conftest import row_list, rows

from ontomill.operators import joins
from ontomill.operators.closure import condense, same_as_closure, same_as_groups, transitive_closure
from ontomill.operators.stats import insert_numbered, last_numbers, number_rows, ordinals


def _sides(spark):
    left = [("hub", f"l{i}") for i in range(50)] + [(f"k{i}", f"l{i}") for i in range(20)]
    right = [("hub", f"r{i}") for i in range(30)] + [(f"k{i}", f"r{i}") for i in range(0, 20, 2)]
    return (
        spark.createDataFrame(left, "k string, l string"),
        spark.createDataFrame(right, "k string, r string"),
    )


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_key_join(spark, how):
    left, right = _sides(spark)
    assert row_list(joins.key_join(left, right, ["k"], how)) == row_list(left.join(right, "k", how))


def test_joins_read_each_input_once(spark):
    """A base table is scanned no more often when nothing is small enough to broadcast."""
    from ontomill.operators.bgp import bgp
    from ontomill.operators.rules import RULES
    from ontomill.plans.catalogue import PATTERNS
    from ontomill.sources.warehouse import warehouse_kb

    def scans() -> dict[str, int]:
        kb = warehouse_kb(spark, "/root/testdata/sf0.001")
        patterns, answer, _ = PATTERNS["bgp_q4"]
        plans = {
            "same_as_prop_individual": RULES["same_as_prop_individual"](kb),
            "subclass_of_all": RULES["subclass_of_all"](kb),
            "bgp_q4": bgp(kb, patterns, [answer]),
        }
        return {
            name: found._jdf.queryExecution().optimizedPlan().collectLeaves().size()
            for name, found in plans.items()
        }

    name = "spark.sql.autoBroadcastJoinThreshold"
    small, before = scans(), spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        assert scans() == small
    finally:
        spark.conf.set(name, before)
    assert all(n > 0 for n in small.values())


def test_insert_new(spark):
    current = spark.createDataFrame([("A", "a")], "cls string, individual string")
    offered = spark.createDataFrame(
        [("A", "a"), ("A", "b"), ("A", "b")], "cls string, individual string"
    )
    inserted, table = joins.insert_new(offered, current)
    assert row_list(inserted) == [("A", "b")]
    assert row_list(table) == [("A", "a"), ("A", "b")]


def _brute_closure(edges):
    closed = set(edges)
    while True:
        more = {(a, d) for a, b in closed for c, d in closed if b == c} - closed
        if not more:
            return closed
        closed |= more


def test_transitive_closure(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(6)] + [("n3", "n1"), ("x", "y")]
    df = spark.createDataFrame(edges, "a string, b string")
    assert rows(transitive_closure(df, "a", "b")) == _brute_closure(edges)


def test_closure_of_random_graphs(spark):
    rnd = random.Random(4)
    for n, m in ((12, 9), (9, 12), (7, 16)):
        edges = [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(m)]
        df = spark.createDataFrame(edges, "a string, b string")
        closed = _brute_closure(edges)
        assert rows(transitive_closure(df, "a", "b")) == closed
        graph = condense(df.select(df.a.alias("src"), df.b.alias("dst")))
        on_cycle = {x for x, y in closed if x == y and any((x, z) in closed and (z, x) in closed and z != x for z, _ in closed)}
        roots = {(x, min(z for z in on_cycle if (x, z) in closed and (z, x) in closed)) for x in on_cycle}
        assert (rows(graph.groups) if graph.groups is not None else set()) == roots
    none = spark.createDataFrame([], "a string, b string")
    assert rows(transitive_closure(none, "a", "b")) == set()


def test_a_long_chain_and_a_long_ring_take_few_rounds(spark):
    chain = spark.range(1_000).selectExpr("id AS src", "id + 1 AS dst")
    graph = condense(chain)
    assert graph.groups is None and len(graph.rounds) <= 11
    assert graph.rounds[-1] == graph.closed.count() == 1_000 * 1_001 // 2
    ring = spark.range(300).selectExpr("id AS src", "(id + 1) % 300 AS dst")
    graph = condense(ring.union(spark.createDataFrame([(7, 900)], "src long, dst long")))
    assert rows(graph.groups) == {(n, 0) for n in range(300)}
    assert rows(graph.closed) == rows(graph.steps) == {(0, 900)}


def _brute_groups(edges):
    nodes = {n for e in edges for n in e}
    linked = _brute_closure(list(itertools.chain(edges, [(b, a) for a, b in edges])))
    return {(n, min(m for a, m in linked if a == n)) for n in nodes}


def test_same_as_groups(spark):
    edges = [(f"c{i:02}", f"c{i + 1:02}") for i in range(12)]
    edges += [("s0", f"s{i}") for i in range(1, 10)] + [("z", "s4"), ("p", "q"), ("q", "p")]
    df = spark.createDataFrame(edges, "ind string, same string")
    assert row_list(same_as_groups(df)) == sorted(_brute_groups(edges))


def test_same_as_closure_follows_direction(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c")]
    df = spark.createDataFrame(edges, "ind string, same string")
    assert rows(same_as_closure(df)) == _brute_closure(edges)


def test_ordinals_in_pieces(spark):
    members = [("hot", f"i{n:04}") for n in range(500)] + [("cold", "i1"), ("cold", "i0")]
    df = spark.createDataFrame(members, "cls string, individual string").repartition(6)
    expected = [("cold", "i0", 1), ("cold", "i1", 2)]
    expected += [("hot", f"i{n:04}", n + 1) for n in range(500)]
    assert row_list(number_rows(df, "cls", "individual")) == expected
    assert row_list(ordinals(df, "cls", "individual")) == expected


def test_ordinals_go_on_with_the_next_batch(spark):
    schema = "cls string, individual string"
    first = ordinals(spark.createDataFrame([("a", "x2"), ("a", "x1"), ("b", "y")], schema), "cls", "individual")
    batch = spark.createDataFrame([("a", "x1"), ("a", "x0"), ("a", "x0"), ("a", "x9"), ("c", "z")], schema)
    added, last = insert_numbered(batch, first, last_numbers(first, "cls"), "cls", "individual")
    assert rows(added) == {("a", "x0", 3), ("a", "x9", 4), ("c", "z", 1)}
    assert rows(last) == {("a", 4), ("b", 1), ("c", 1)}
    again, last = insert_numbered(batch, first.unionByName(added), last, "cls", "individual")
    assert rows(again) == set() and rows(last) == {("a", 4), ("b", 1), ("c", 1)}
    assert dict(first.dtypes)["num"] == dict(added.dtypes)["num"] == "bigint"


def test_keys_in_several_pieces_are_numbered_on(spark):
    df = spark.range(4_000).selectExpr("CASE WHEN id < 3000 THEN 'a' ELSE concat('b', id % 7) END AS k", "id")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")  # four pieces, most of them of one key
    try:
        found = row_list(number_rows(df, "k", "id", total="n"))
    finally:
        spark.conf.set(name, before)
    members = {}
    for k, i in row_list(df):
        members.setdefault(k, []).append(i)
    assert found == [(k, i, num, len(ids)) for k, ids in members.items() for num, i in enumerate(ids, 1)]

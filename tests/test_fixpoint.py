"""Materialisation against a direct computation, and its properties."""

import random
from collections import defaultdict

import pytest
from conftest import row_list, rows
from pyspark.sql import functions as F

from ontomill.kb import KnowledgeBase
from ontomill.operators import joins
from ontomill.operators.components import written_out
from ontomill.operators.rules import RULES, SINGLE_VALUE_RULES, all_same_pairs
from ontomill.plans import fixpoint
from ontomill.plans.fixpoint import materialise
from ontomill.schema import FACT_TABLES, OWL_THING, TABLES

CI, PI, SA = FACT_TABLES


def _sample(seed: int) -> dict:
    rnd = random.Random(seed)
    classes = [f"C{i}" for i in range(9)]
    props = [f"P{i}" for i in range(4)]
    people = [f"i{i}" for i in range(8)]

    def some(n, *pools):
        return sorted({tuple(rnd.choice(pool) for pool in pools) for _ in range(n)})

    return dict(
        class_individuals=some(10, classes, people),
        prop_individuals=some(10, props, people, people),
        subclass_of_class=some(3, classes, classes),
        subclass_of_all=some(2, classes, props, classes),
        subclass_of_some=some(2, classes, props, classes),
        subclass_of_union=some(1, classes, classes, classes),
        equivalent_to_class=some(1, classes, classes),
        equivalent_to_some=some(2, classes, props, classes),
        equivalent_to_intersection=some(2, classes, classes, classes),
        equivalent_to_union=some(1, classes, classes, classes),
        equivalent_to_max_cardinality=[(c, p, 1, OWL_THING) for c, p in some(1, classes, props)],
        equivalent_to_min_cardinality=[(c, p, 1, OWL_THING) for c, p in some(1, classes, props)],
        complement_of=some(3, classes, classes),
        disjoint_with=some(1, classes, classes),
        functional_property=some(1, props),
        inverse_functional_property=some(1, props),
        op_domain=some(1, classes, props),
        op_range=some(1, classes, props),
        inverse_of=some(1, props, props),
        sub_property_of=some(2, props, props),
        equivalent_property=some(1, props, props),
    )


def _brute(t: dict, chains: bool = False) -> tuple[set, set, set]:
    """The stated rules over Python sets, equal individuals as all pairs; over all ``chains``
    of them, both ways, if asked for."""
    t = defaultdict(list, t)
    ci, pi, sa = set(t["class_individuals"]), set(t["prop_individuals"]), set(t["same_as"])
    functional = {p for (p,) in t["functional_property"]}
    while True:
        nc, np, ns = set(), set(), set()
        members = {}
        for c, x in ci:
            members.setdefault(c, set()).add(x)

        def of(c, members=members):
            return members.get(c, set())

        comp = t["complement_of"]
        nc |= {(d, x) for k, d in comp for e, c in comp if c == k for x in of(e)}
        nc |= {
            (i, x)
            for a, b in t["subclass_of_class"]
            for i, a2 in comp
            for j, b2 in comp
            if a2 == a and b2 == b
            for x in of(j)
        }
        nc |= {(i, x) for a, b in t["disjoint_with"] for k, i in comp if k == b for x in of(a)}
        nc |= {(c, a) for c, p in t["op_domain"] for q, a, b in pi if p == q}
        nc |= {(c, b) for c, p in t["op_range"] for q, a, b in pi if p == q}
        nc |= {(c, a) for c, p, _, _ in t["equivalent_to_min_cardinality"] for q, a, b in pi if p == q}
        for a, b in t["subclass_of_class"] + t["equivalent_to_class"]:
            nc |= {(b, x) for x in of(a)}
        for c, a, b in t["equivalent_to_intersection"]:
            nc |= {(d, x) for d in (a, b) for x in of(c)} | {(c, x) for x in of(a) & of(b)}
        for c, a, b in t["equivalent_to_union"]:
            nc |= {(c, x) for x in of(a) | of(b)}
        for c, a, b in t["equivalent_to_union"] + t["subclass_of_union"]:
            for k, d in comp:
                if d == a:
                    nc |= {(b, x) for x in of(c) & of(k)}
                if d == b:
                    nc |= {(a, x) for x in of(c) & of(k)}
        guarded = t["subclass_of_all"] + [
            r for r in t["subclass_of_some"] + t["equivalent_to_some"] if r[1] in functional
        ]
        for c, p, d in guarded:
            nc |= {(d, b) for q, a, b in pi if q == p and a in of(c)}
        for c, p, d in t["equivalent_to_some"]:
            nc |= {(c, a) for q, a, b in pi if q == p and b in of(d)}
        for p, q in t["inverse_of"]:
            np |= {(q, b, a) for r, a, b in pi if r == p}
        for p, q in t["sub_property_of"] + t["equivalent_property"]:
            np |= {(q, a, b) for r, a, b in pi if r == p}
        for p, a, b in pi:
            for q, a2, b2 in pi:
                if p == q and a == a2 and b != b2:
                    if p in functional:
                        ns.add((b, b2))
                    if any(m == p and a in of(c) for c, m, _, _ in t["equivalent_to_max_cardinality"]):
                        ns.add((b, b2))
                if p == q and b == b2 and a != a2 and (p,) in t["inverse_functional_property"]:
                    ns.add((a, a2))
        if chains:
            ns |= {(y, x) for x, y in sa}
            ns |= {(x, z) for x, y in sa for y2, z in sa if y == y2 and x != z}
        nc |= {(c, y) for c, x in ci for z, y in sa if z == x}
        np |= {(p, y, b) for p, a, b in pi for z, y in sa if z == a}
        if nc <= ci and np <= pi and ns <= sa:
            return ci, pi, sa
        ci, pi, sa = ci | nc, pi | np, sa | ns


def _pairs(kb) -> set:
    return set().union(*(rows(all_same_pairs(kb, r)) for r in SINGLE_VALUE_RULES))


@pytest.mark.parametrize("seed", range(4))
def test_equals_direct_computation(spark, seed):
    tables = _sample(seed)
    closed = materialise(KnowledgeBase.from_rows(spark, **tables)).kb
    ci, pi, sa = _brute(tables)
    assert rows(closed[CI]) == ci
    assert rows(closed[PI]) == pi
    assert _pairs(closed) == sa


@pytest.mark.parametrize("seed", range(3))
def test_what_is_wanted_is_whole(spark, seed):
    tables = _sample(seed)
    kb = KnowledgeBase.from_rows(spark, **tables)
    ci, pi, sa = _brute(tables)
    assert rows(materialise(kb, wanted={CI: None}).kb[CI]) == ci
    assert rows(materialise(kb, wanted={PI: None}).kb[PI]) == pi
    assert rows(materialise(kb, wanted={SA: None}).kb[SA]) == rows(materialise(kb).kb[SA])
    some = materialise(kb, wanted={CI: {"C1"}, PI: {"P1"}}).kb
    assert rows(some[CI].filter("cls = 'C1'")) == {f for f in ci if f[0] == "C1"}
    assert rows(some[PI].filter("prop = 'P1'")) == {f for f in pi if f[0] == "P1"}


def test_what_leads_to_nothing_wanted_is_not_stored(spark, monkeypatch):
    tables = dict(
        class_individuals=[("A", "a"), ("Other", "a"), ("Guard", "x")],
        prop_individuals=[("one", "x", "a"), ("one", "x", "b"), ("p", "a", "c"), ("q", "a", "c")],
        subclass_of_class=[("A", "B"), ("B", "C"), ("Other", "More")],
        subclass_of_all=[("Guard", "p", "C")],
        sub_property_of=[("q", "r")],
        functional_property=[("one",)],
    )
    kb = KnowledgeBase.from_rows(spark, **tables)
    run = materialise(kb, wanted={CI: {"C"}})
    stored = {r[0] for n in (CI, PI) for r in rows(run.run.facts[n].full)}
    assert stored == {"A", "B", "C", "Guard", "one", "p"}  # links of equals lead to C as well
    assert rows(run.kb[CI].filter("cls = 'C'")) == {("C", "a"), ("C", "b")}
    alone = materialise(kb, rules={"functional_property"}, wanted={SA: None}).run
    assert alone.facts[CI].full is None and rows(alone.facts[PI].full.select("prop")) == {("one",)}
    with pytest.raises(ValueError):
        materialise(run, added=kb)
    with pytest.raises(ValueError):
        materialise(kb, wanted={"subclass_of_class": None})
    monkeypatch.setattr(fixpoint, "MAX_KEY_VALUES", 1)
    many = materialise(kb, wanted={CI: {"C"}})
    assert rows(many.kb[CI].filter("cls = 'C'")) == {("C", "a"), ("C", "b")}


def test_a_join_without_new_facts_on_either_side_is_left_out(spark):
    kb = KnowledgeBase.from_rows(
        spark,
        class_individuals=[("A", "a"), ("G", "x")],
        prop_individuals=[("p", "x", "a"), ("one", "x", "a"), ("one", "x", "b")],
        subclass_of_all=[("G", "p", "H")],
        equivalent_to_intersection=[("AH", "A", "H")],
        functional_property=[("one",)],
    )
    run = materialise(kb, rules=set(RULES) - {"same_as_transitive_closure", "same_as_class_individual"})
    joins = {}
    for stage, table, source, _, _ in row_list(run.derivations()):
        if stage:
            joins.setdefault(table, {}).setdefault(stage, set()).add(source)
    # a is in H by the guard, then in AH by both; the guard and the single value are not met again
    assert joins[CI] == {1: {"guarded"}, 2: {"pair"}, 3: {"class"}}
    assert joins[SA] == {1: {"single_value"}}
    assert rows(run.kb[CI]) == {("A", "a"), ("G", "x"), ("H", "a"), ("AH", "a")}


def _split(tables: dict, seed: int) -> tuple[dict, dict]:
    """Facts and axioms in two random halves."""
    rnd = random.Random(seed)
    known, later = {}, {}
    for name, table in tables.items():
        chosen = [rnd.random() < 0.5 for _ in table]
        known[name] = [r for r, first in zip(table, chosen) if first]
        later[name] = [r for r, first in zip(table, chosen) if not first]
    return known, later


def _least_links(groups: dict) -> set:
    return {pair for x, root in groups.items() if x != root for pair in ((x, root), (root, x))}


def _roots(sa: set) -> dict:
    """The smallest individual of each group, from all pairs of equal individuals."""
    return {x: min([x, *(b for a, b in sa if a == x)]) for x in {x for pair in sa for x in pair}}


@pytest.mark.parametrize("seed", range(2))
def test_continuing_equals_a_run_from_scratch(spark, seed):
    tables = _sample(seed)
    known, later = _split(tables, seed)
    before = materialise(KnowledgeBase.from_rows(spark, **known))
    stored = {name: [s.path for s in f.stages] for name, f in before.run.facts.items()}
    result = materialise(before, added=KnowledgeBase.from_rows(spark, **later))
    ci, pi, sa = _brute(tables)
    assert (rows(result.kb[CI]), rows(result.kb[PI]), _pairs(result.kb)) == (ci, pi, sa)
    # The known tables are used where they are; stage 0 is what was not known.
    for name, facts in result.run.facts.items():
        assert [s.path for s in facts.stages][: len(stored[name])] == stored[name]
    given = {s.table: s.inserted for s in result.stats if s.stage == 0}
    assert given[CI] == len(set(later[CI]) - rows(before.kb[CI]))
    assert given[PI] == len(set(later[PI]) - rows(before.kb[PI]))


def test_known_facts_meet_only_what_is_new(spark):
    before = materialise(
        KnowledgeBase.from_rows(
            spark,
            class_individuals=[("A", f"a{i}") for i in range(50)],
            subclass_of_class=[("A", "B"), ("B", "C")],
        )
    )
    nothing = materialise(before, added=KnowledgeBase.from_rows(spark, class_individuals=[("A", "a0")]))
    assert all(s.inserted == 0 and sum(s.derived.values()) <= 1 for s in nothing.stats)
    one = materialise(before, added=KnowledgeBase.from_rows(spark, class_individuals=[("B", "b")]))
    assert [s.derived for s in one.stats if s.table == CI and s.stage == 1] == [{"class": 1}]
    axiom = materialise(before, added=KnowledgeBase.from_rows(spark, subclass_of_class=[("C", "D")]))
    # A -> D, B -> D, C -> D are new; the others are not applied again.
    assert [s.derived for s in axiom.stats if s.table == CI and s.stage == 1] == [{"class": 150}]
    assert rows(axiom.kb[CI]) == {(c, f"a{i}") for c in "ABCD" for i in range(50)}
    with pytest.raises(ValueError):
        materialise(before)
    with pytest.raises(ValueError):
        materialise(before, added=axiom.kb, same_as_closure=True)
    axiom.close()
    assert rows(before.kb[CI]) == {(c, f"a{i}") for c in "ABC" for i in range(50)}


def test_a_closed_knowledge_base_is_continued(spark):
    tables = _sample(5)
    known, later = _split(tables, 5)
    closed = materialise(KnowledgeBase.from_rows(spark, **known)).kb
    result = materialise(closed, added=KnowledgeBase.from_rows(spark, **later))
    ci, pi, _ = _brute(tables)
    assert (rows(result.kb[CI]), rows(result.kb[PI])) == (ci, pi)


@pytest.mark.parametrize("seed", range(2))
def test_facts_spread_over_chains_of_equal_individuals(spark, seed):
    tables = _sample(seed + 10)
    rnd = random.Random(seed)
    tables["same_as"] = sorted({(f"i{rnd.randrange(8)}", f"i{rnd.randrange(8)}") for _ in range(3)})
    tables["same_as"] = [(a, b) for a, b in tables["same_as"] if a != b]
    ci, pi, sa = _brute(tables, chains=True)
    whole = materialise(KnowledgeBase.from_rows(spark, **tables), same_as_closure=True)
    assert (rows(whole.kb[CI]), rows(whole.kb[PI])) == (ci, pi)
    given = set(tables["same_as"])
    assert rows(whole.kb[SA]) == _least_links(_roots(sa)) | given
    known, later = _split(tables, seed)
    before = materialise(KnowledgeBase.from_rows(spark, **known), same_as_closure=True)
    after = materialise(before, added=KnowledgeBase.from_rows(spark, **later), same_as_closure=True)
    assert (rows(after.kb[CI]), rows(after.kb[PI])) == (ci, pi)
    assert rows(after.kb[SA]) == _least_links(_roots(sa)) | given


def test_groups_of_equals_are_not_written_out_while_facts_are_derived(spark):
    n = 30
    given = {
        "class_individuals": [(f"C{i}", f"d{i:02}") for i in range(n)],
        "prop_individuals": [("at", f"d{i:02}", f"t{j}") for i in range(n) for j in (i, i + 1)],
        "inverse_functional_property": [("at",)],
        "subclass_of_class": [("C0", "Top")],
    }
    kb = KnowledgeBase.from_rows(spark, **given)
    result = materialise(kb, same_as_closure=True)
    everyone = [f"d{i:02}" for i in range(n)]
    links = {("at", d, f"t{j}") for d in everyone for j in range(n + 1)}
    classes = {(c, d) for d in everyone for c in ["Top"] + [f"C{i}" for i in range(n)]}
    assert row_list(result.kb[PI]) == sorted(links) and row_list(result.kb[CI]) == sorted(classes)
    # n individuals with 2 n links are n (n + 1) rows in the result; each fact was kept at the root too.
    assert sum(s.inserted for s in result.stats if s.table == PI) <= 2 * (2 * n)
    assert sum(s.inserted for s in result.stats if s.table == CI) <= 3 * n
    # Links that are turned round need all members; the result can be continued with such a rule.
    later = KnowledgeBase.from_rows(spark, inverse_of=[("at", "of")], class_individuals=[("D", "d00")])
    after = materialise(result, added=later, same_as_closure=True).kb
    assert rows(after[PI]) == links | {("of", t, d) for _, d, t in links}
    assert rows(after[CI]) == classes | {("D", d) for d in everyone}


def test_pieces_of_a_large_group_are_written_out_once(spark, monkeypatch):
    monkeypatch.setattr("ontomill.operators.components.PIECE", 3)
    groups = spark.createDataFrame([(f"a{i}", "a0") for i in range(20)] + [("b1", "b0"), ("b0", "b0")], "ind string, root string")
    facts = spark.createDataFrame([("p", "a7", "b1"), ("p", "a0", "b0"), ("q", "x", "a1")], "prop string, domain string, range string")
    for ends in (["domain"], ["domain", "range"]):
        tos = ["b0", "b1"]
        wanted = [("p", f"a{i}", b) for i in range(20) for b in tos]
        wanted += [("q", "x", f"a{i}") for i in range(20)] if len(ends) == 2 else [("q", "x", "a1")]
        assert row_list(written_out(facts, groups, ends)) == sorted(wanted)


def test_rows_of_a_large_group_are_dealt_out_with_few_facts_a_task(spark, monkeypatch):
    for name, value in (("PIECE", 8), ("SLAB", 16), ("ROWS_A_TASK", 1_000)):
        monkeypatch.setattr(f"ontomill.operators.components.{name}", value, raising=False)
    everyone, values = [f"a{i:03}" for i in range(100)], [f"v{i}" for i in range(300)]
    groups = spark.createDataFrame([(a, "a000") for a in everyone], "ind string, root string")
    facts = spark.createDataFrame(
        [("p", "a000", v) for v in values] + [("p", "a007", "v0"), ("p", "x", "v1"), ("p", None, "v2")],
        "prop string, domain string, range string",
    )
    out = written_out(facts, groups, ["domain"])
    wanted = {("p", a, v) for a in everyone for v in values} | {("p", "x", "v1"), ("p", None, "v2")}
    found = [tuple(r) for r in out.collect()]
    assert len(found) == len(wanted) and set(found) == wanted
    tasks = out.groupBy(F.spark_partition_id().alias("task")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("range").alias("facts")
    )
    # 30,000 rows that come from some 300 short ones are not left to the one task these would fit in.
    assert all(r["rows"] <= 6_000 and r["facts"] <= 200 for r in tasks.collect())


def test_a_long_chain_of_stages_keeps_few_tables(spark):
    chain = KnowledgeBase.from_rows(
        spark,
        class_individuals=[("C", "x00")],
        prop_individuals=[("p", f"x{i:02}", f"x{i + 1:02}") for i in range(30)],
        subclass_of_all=[("C", "p", "C")],
    )
    result = materialise(chain)
    assert rows(result.kb[CI]) == {("C", f"x{i:02}") for i in range(31)}
    assert max(s.stage for s in result.stats) == 31
    assert len(result.run.facts[CI].stages) <= fixpoint.MOST_TABLES + 2
    derived = {r["stage"]: r["derived"] for r in result.derivations().collect() if r["source"] == "guarded"}
    assert derived == {n: 1 for n in range(1, 31)} | {31: 0}


def test_large_ontologies_and_hubs_take_the_other_paths(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "MAX_CLOSED_EDGES", 2)
    monkeypatch.setattr(fixpoint, "MAX_KEY_VALUES", 0)
    monkeypatch.setattr("ontomill.sources.scratch.LITERAL_ROWS", 0)
    tables = _sample(1)
    closed = materialise(KnowledgeBase.from_rows(spark, **tables)).kb
    ci, pi, _ = _brute(tables)
    assert (rows(closed[CI]), rows(closed[PI])) == (ci, pi)


def test_again_adds_nothing_and_keeps_what_was_there(spark):
    kb = KnowledgeBase.from_rows(spark, **_sample(2))
    once = materialise(kb)
    for name in (CI, PI):
        assert rows(kb[name]) <= rows(once.kb[name])
    twice = materialise(once.kb)
    assert all(s.inserted == 0 for s in twice.stats if s.stage > 0)
    for name in FACT_TABLES:
        assert rows(twice.kb[name]) == rows(once.kb[name])
    stats = once.stats_frame()
    assert stats.columns == ["stage", "table", "inserted", "seconds"]


def test_copies_share_what_is_known_of_any(spark):
    kb = KnowledgeBase.from_rows(
        spark,
        class_individuals=[("Good", "d3")],
        prop_individuals=[("has", f"d{i}", "t") for i in range(6)] + [("from", "d5", "s")],
        inverse_functional_property=[("has",)],
    )
    result = materialise(kb)
    assert rows(result.kb[CI]) == {("Good", f"d{i}") for i in range(6)}
    assert {("from", f"d{i}", "s") for i in range(6)} <= rows(result.kb[PI])
    assert rows(result.kb[SA]) == {(f"d{i}", "d0") for i in range(1, 6)} | {
        ("d0", f"d{i}") for i in range(1, 6)
    }
    assert rows(result.same_as_groups()) == {(f"d{i}", "d0") for i in range(6)}


def test_rule_choice_object_side_and_stage_limit(spark):
    kb = KnowledgeBase.from_rows(
        spark,
        same_as=[("a", "b"), ("b", "a")],
        prop_individuals=[("p", "x", "a")],
        equivalent_property=[("p", "q")],
    )
    assert rows(materialise(kb, same_as_objects=True).kb[PI]) == {
        (p, "x", o) for p in "pq" for o in "ab"
    }
    without = set(RULES) - {"object_property_equivalent_to_class", "same_as_transitive_closure"}
    assert rows(materialise(kb, rules=without).kb[PI]) == {("p", "x", "a")}
    chain = KnowledgeBase.from_rows(
        spark,
        class_individuals=[("C", "x0")],
        prop_individuals=[("p", f"x{i}", f"x{i + 1}") for i in range(5)],
        subclass_of_all=[("C", "p", "C")],
    )
    assert rows(materialise(chain).kb[CI]) == {("C", f"x{i}") for i in range(6)}
    with pytest.raises(RuntimeError):
        materialise(chain, max_stages=2)
    with pytest.raises(KeyError):
        materialise(kb, rules={"no such rule"})


def test_store_and_read(spark, tmp_path):
    kb = KnowledgeBase.from_rows(spark, **_sample(3))
    kb.write(str(tmp_path / "kb"))
    back = KnowledgeBase.read(spark, str(tmp_path / "kb"))
    for name in TABLES:
        assert rows(back[name]) == rows(kb[name])
        assert back[name].schema.fieldNames() == TABLES[name].fieldNames()
    with pytest.raises(KeyError):
        KnowledgeBase(spark, {"nope": kb[CI]})

"""N-Triples in, knowledge-base tables out."""

import random
import re

import pytest
from conftest import row_list, rows

from ontomill.operators import hierarchy
from ontomill.operators.stats import axiom_counts
from ontomill.plans.build_kb import build_kb, kb_from_triples
from ontomill.plans.fixpoint import materialise
from ontomill.schema import OWL, OWL_THING, RDF, RDFS
from ontomill.sources import axioms
from ontomill.sources.class_expressions import Chains, decompose, list_cells
from ontomill.sources.scratch import Scratch
from ontomill.sources.ntriples import (
    format_ntriples,
    parse_ntriples,
    read_ntriples,
    write_answers,
)

E = "http://example.org/"
PREFIXES = {"owl": OWL, "rdf": RDF, "rdfs": RDFS, "": E}


def term(text: str) -> str:
    if text.startswith(("_:", '"')):
        return text
    prefix, name = text.split(":", 1)
    return PREFIXES[prefix] + name


def triples(spark, text: str):
    data = [tuple(map(term, line.split())) for line in text.strip().splitlines()]
    return spark.createDataFrame(data, "s string, p string, o string")


def short(found: set) -> set:
    return {tuple(v.replace(E, ":") if isinstance(v, str) else v for v in r) for r in found}


def test_lines(spark):
    good = [
        '<http://a> <http://p> <http://b> .',
        '_:x <http://p> "say \\"hi\\" . # no comment"@en-GB .',
        '<http://a>\t<http://p>  "5"^^<http://t#int> . # a comment',
        "<http://a> <http://p> _:y.",
    ]
    skipped = ["", "   ", "# only a comment"]
    bad = ['<http://a> <http://p> "open .', "<http://a> <http://b> .", '"lit" <http://p> <http://b> .',
           "<http://a> <http://p> <http://b>"]
    lines = spark.createDataFrame([(v,) for v in good + skipped + bad], "value string")
    found, rejects = parse_ntriples(lines)
    assert rows(found) == {
        ("http://a", "http://p", "http://b"),
        ("_:x", "http://p", '"say \\"hi\\" . # no comment"@en-GB'),
        ("http://a", "http://p", '"5"^^<http://t#int>'),
        ("http://a", "http://p", "_:y"),
    }
    assert rows(rejects) == {(v,) for v in bad}
    assert rows(parse_ntriples(format_ntriples(found))[0]) == rows(found)


def test_blank_nodes_of_two_files_differ(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for path in (tmp_path / "a.nt", tmp_path / "deep" / "b.nt"):
        path.write_text("_:n <http://p> <http://o> .\nbroken\n")
    found, rejects = read_ntriples(spark, str(tmp_path))
    subjects = [s for s, _, _ in row_list(found)]
    assert len(set(subjects)) == 2 and all(s.startswith("_:") for s in subjects)
    assert row_list(rejects) == [("broken",), ("broken",)]


INDIVIDUALS = """
:painting rdf:type :Hobby
:painting rdf:type owl:NamedIndividual
:pepe rdf:type :Student
:pepe rdf:type owl:Thing
_:who rdf:type :Student
:pepe :like :puzzle
:pepe :hates :puzzle
:pepe :age "9"
:pepe :unknown :puzzle
:pepe owl:sameAs :jose
"""
ONTOLOGY = """
:literature rdf:type :Hobby
:like rdf:type owl:ObjectProperty
:like rdf:type owl:InverseFunctionalProperty
:hates rdf:type owl:ObjectProperty
:hates rdf:type owl:FunctionalProperty
:both rdf:type owl:InverseFunctionalProperty
:both rdf:type owl:FunctionalProperty
:age rdf:type owl:FunctionalProperty
:Student rdf:type owl:Class
"""


def test_individuals(spark):
    own, imported = triples(spark, INDIVIDUALS), triples(spark, ONTOLOGY)
    assert short(rows(axioms.class_assertions(own))) == {(":Hobby", ":painting"), (":Student", ":pepe")}
    assert axioms.class_assertions(own.unionByName(imported)).count() == 3
    properties = axioms.object_properties(imported)
    assert short(rows(axioms.property_assertions(own, properties))) == {
        (":like", ":pepe", ":puzzle"),
        (":hates", ":pepe", ":puzzle"),
    }
    assert short(rows(axioms.functional_properties(imported))) == {(":hates",), (":both",)}
    assert short(rows(axioms.inverse_functional_properties(imported))) == {(":like",), (":both",)}
    assert short(rows(axioms.same_individuals(own))) == {(":pepe", ":jose"), (":jose", ":pepe")}


def test_property_and_class_axioms(spark):
    t = triples(
        spark,
        """
        :p1 rdf:type owl:ObjectProperty
        :p2 rdf:type owl:ObjectProperty
        :p3 rdf:type owl:ObjectProperty
        :p1 owl:inverseOf :p2
        :p3 owl:inverseOf :p3
        :p1 rdfs:subPropertyOf :p2
        :p2 rdfs:subPropertyOf :p3
        :p2 owl:equivalentProperty :p1
        :p3 rdfs:domain :A
        :p2 rdfs:range :B
        :data rdfs:range :B
        :A owl:disjointWith :B
        _:d rdf:type owl:AllDisjointClasses
        _:d owl:members _:c1
        _:c1 rdf:first :K
        _:c1 rdf:rest _:c2
        _:c2 rdf:first :L
        _:c2 rdf:rest _:c3
        _:c3 rdf:first :M
        _:c3 rdf:rest rdf:nil
        :J rdfs:subClassOf :K
        """,
    )
    assert short(rows(axioms.inverse_properties(t))) == {(":p1", ":p2"), (":p2", ":p1")}
    assert short(rows(axioms.super_properties(t))) == {(":p1", ":p2"), (":p2", ":p3")}
    assert short(rows(axioms.equivalent_properties(t))) == {(":p2", ":p1")}
    assert short(rows(axioms.disjoint_classes(t))) == {(":A", ":B")}
    members, broken = axioms.disjoint_lists(t)
    assert short(rows(members)) == {("_:d", ":K"), ("_:d", ":L"), ("_:d", ":M")}
    assert rows(broken) == set()
    kb = kb_from_triples(t, t).kb
    assert short(rows(kb["op_domain"])) == {(":A", ":p1"), (":A", ":p2"), (":A", ":p3")}
    assert short(rows(kb["op_range"])) == {(":B", ":p1"), (":B", ":p2")}
    assert short(rows(kb["super_class_of"])) == {(":K", ":J")}


EXPRESSIONS = """
:A owl:equivalentClass _:some
_:some owl:onProperty :p
_:some owl:someValuesFrom _:inter
_:inter owl:intersectionOf _:i1
_:i1 rdf:first :B
_:i1 rdf:rest _:i2
_:i2 rdf:first _:not
_:i2 rdf:rest _:i3
_:i3 rdf:first :C
_:i3 rdf:rest _:i4
_:i4 rdf:first :D
_:i4 rdf:rest rdf:nil
_:not owl:complementOf :N
:E rdfs:subClassOf _:all
_:all owl:onProperty _:inv
_:all owl:allValuesFrom :F
_:inv owl:inverseOf :p
:G rdfs:subClassOf _:max
_:max owl:onProperty :p
_:max owl:maxCardinality "1"^^<http://www.w3.org/2001/XMLSchema#nonNegativeInteger>
_:min owl:equivalentClass :G
_:min owl:onProperty :p
_:min owl:minQualifiedCardinality "2"^^<http://www.w3.org/2001/XMLSchema#nonNegativeInteger>
_:min owl:onClass :H
:U owl:unionOf _:u1
_:u1 rdf:first :V
_:u1 rdf:rest _:u2
_:u2 rdf:first :W
_:u2 rdf:rest rdf:nil
:One owl:equivalentClass _:one
_:one owl:unionOf _:o1
_:o1 rdf:first :Only
_:o1 rdf:rest rdf:nil
:Two rdfs:subClassOf _:two
_:two owl:intersectionOf _:t1
_:t1 rdf:first :Sole
_:t1 rdf:rest rdf:nil
:Odd owl:equivalentClass _:odd
_:odd owl:hasValue :x
:Gone owl:equivalentClass _:gone
_:gone owl:unionOf _:nowhere
"""


def test_class_expressions(spark):
    found = decompose(triples(spark, EXPRESSIONS))
    t = {name: short(rows(found.kb[name])) for name in (
        "equivalent_to_some", "equivalent_to_intersection", "complement_of", "subclass_of_all",
        "subclass_of_max_cardinality", "equivalent_to_min_cardinality", "equivalent_to_union",
        "equivalent_to_class", "subclass_of_class", "equivalent_to_all",
    )}
    assert t["equivalent_to_some"] == {(":A", ":p", "_:inter")}
    assert t["equivalent_to_intersection"] == {
        ("_:inter", ":B", "_:i2"),
        ("_:i2", "_:not", "_:i3"),
        ("_:i3", ":C", ":D"),
    }
    assert t["complement_of"] == {("_:not", ":N")}
    assert t["subclass_of_all"] == {(":E", "_:inv", ":F")}
    assert t["subclass_of_max_cardinality"] == {(":G", ":p", 1, OWL_THING)}
    assert t["equivalent_to_min_cardinality"] == {(":G", ":p", 2, ":H")}
    assert t["equivalent_to_union"] == {(":U", ":V", ":W")}
    assert t["equivalent_to_class"] == {(":One", ":Only"), (":Only", ":One")}
    assert t["subclass_of_class"] == {(":Two", ":Sole")}
    assert t["equivalent_to_all"] == set()
    assert short(rows(found.rejects)) == {(":Odd", "_:odd"), (":Gone", "_:gone")}


def test_long_lists_and_rings_end(spark):
    n = 40
    cells = [(f"_:c{i:02}", RDF + "first", f"{E}k{i:02}") for i in range(n)]
    cells += [
        (f"_:c{i:02}", RDF + "rest", f"_:c{i + 1:02}" if i + 1 < n else RDF + "nil")
        for i in range(n)
    ]
    ring = [("_:r1", RDF + "first", E + "x"), ("_:r2", RDF + "first", E + "y")]
    ring += [("_:r1", RDF + "rest", "_:r2"), ("_:r2", RDF + "rest", "_:r1")]
    head = [(E + "A", OWL + "equivalentClass", "_:a"), ("_:a", OWL + "intersectionOf", "_:c00")]
    found = decompose(spark.createDataFrame(cells + head, "s string, p string, o string"))
    pairs = short(rows(found.kb["equivalent_to_intersection"]))
    assert len(pairs) == n - 1
    assert (":A", ":k00", "_:c01") in pairs and ("_:c38", ":k38", ":k39") in pairs
    # A list that runs in a ring has no first cell; it yields nothing and is reported.
    head = [(E + "R", OWL + "equivalentClass", "_:q"), ("_:q", OWL + "unionOf", "_:r1")]
    found = decompose(spark.createDataFrame(ring + head, "s string, p string, o string"))
    assert rows(found.kb["equivalent_to_union"]) == set()
    assert short(rows(found.rejects)) == {(":R", "_:q")}


def test_a_ring_behind_other_cells_is_rejected(spark):
    cells = {"_:c1": "_:c2", "_:c2": "_:c3", "_:c3": "_:c2"}
    triples = [(c, RDF + "rest", n) for c, n in cells.items()]
    triples += [(c, RDF + "first", E + c[2:].upper()) for c in cells]
    triples += [(E + "R", OWL + "equivalentClass", "_:q"), ("_:q", OWL + "unionOf", "_:c1")]
    found = decompose(spark.createDataFrame(triples, "s string, p string, o string"))
    assert rows(found.kb["equivalent_to_union"]) == set()
    assert rows(found.rejects) == {(E + "R", "_:q")}


def test_every_expression_of_a_class_is_kept(spark):
    """Two unions and two complements of one class; a node with two fillers is rejected."""
    triples = [(E + "A", OWL + "complementOf", E + c) for c in ("X", "Y")]
    for k, (one, other) in enumerate([("B", "C"), ("D", "F")]):
        triples += [
            (E + "A", OWL + "unionOf", f"_:l{k}a"),
            (f"_:l{k}a", RDF + "first", E + one),
            (f"_:l{k}a", RDF + "rest", f"_:l{k}b"),
            (f"_:l{k}b", RDF + "first", E + other),
            (f"_:l{k}b", RDF + "rest", RDF + "nil"),
        ]
    triples += [
        (E + "Z", OWL + "equivalentClass", "_:z"),
        ("_:z", OWL + "onProperty", E + "p"),
        ("_:z", OWL + "someValuesFrom", E + "G"),
        ("_:z", OWL + "someValuesFrom", E + "H"),
        (E + "N", OWL + "equivalentClass", "_:n"),
        ("_:n", OWL + "onProperty", E + "p"),
        ("_:n", OWL + "minCardinality", '"1.5"'),
    ]
    found = decompose(spark.createDataFrame(triples, "s string, p string, o string"))
    unions = {(E + "A", E + "B", E + "C"), (E + "A", E + "D", E + "F")}
    assert rows(found.kb["equivalent_to_union"]) == unions
    assert rows(found.kb["complement_of"]) == {(E + "A", E + "X"), (E + "A", E + "Y")}
    assert rows(found.rejects) == {(E + "Z", "_:z"), (E + "N", "_:n")}


def test_expressions_in_domains_and_disjointness(spark):
    t = triples(
        spark,
        """
        :p rdf:type owl:ObjectProperty
        :q rdf:type owl:ObjectProperty
        :p rdfs:domain _:u
        _:u owl:unionOf _:u1
        _:u1 rdf:first :B
        _:u1 rdf:rest _:u2
        _:u2 rdf:first :C
        _:u2 rdf:rest rdf:nil
        :A owl:disjointWith _:n
        _:n owl:complementOf :D
        _:some rdfs:subClassOf :F
        _:some owl:onProperty :p
        _:some owl:someValuesFrom :B
        _:inv owl:inverseOf :q
        _:inv rdfs:subPropertyOf :p
        _:d rdf:type owl:AllDisjointClasses
        _:d owl:members _:r1
        _:r1 rdf:first :B
        _:r1 rdf:rest _:r2
        _:r2 rdf:first :C
        _:r2 rdf:rest _:r1
        :q rdfs:range _:odd
        _:odd owl:oneOf rdf:nil
        """,
    )
    built = kb_from_triples(t, t)
    kb = built.kb
    assert short(rows(kb["op_domain"])) >= {("_:u", ":p")}
    assert short(rows(kb["equivalent_to_union"])) == {("_:u", ":B", ":C")}
    assert short(rows(kb["disjoint_with"])) == {(":A", "_:n")}
    assert short(rows(kb["complement_of"])) == {("_:n", ":D")}
    assert ("_:some", ":F") in short(rows(kb["subclass_of_class"]))
    assert short(rows(kb["equivalent_to_some"])) == {("_:some", ":p", ":B")}
    assert short(rows(kb["sub_property_of"])) == {("_:inv", ":p")}
    assert rows(kb["disjoint_members"]) == set()
    assert rows(built.bad_expressions) == {("_:odd", "_:odd"), ("_:d", "_:r1")}


def test_ntriples_without_white_space_and_with_quoted_comments(spark):
    from ontomill.sources.ntriples import parse_ntriples

    lines = ["<a:s><a:p><a:o>.", '<a:s> <a:p> <a:o2> . # say "x"', '<a:s> <a:p> "a \\"b\\" . c"@en .', "<a:s> <a:p> ."]
    triples, rejects = parse_ntriples(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert triples.count() == 3 and {r["o"] for r in triples.collect()} >= {"a:o", "a:o2"}
    assert [r["line"] for r in rejects.collect()] == ["<a:s> <a:p> ."]


def _brute_direct(steps: set) -> set:
    nodes = {n for s in steps for n in s}
    up = {n: {b for a, b in steps if a == n} for n in nodes}
    for _ in nodes:
        up = {n: up[n].union(*(up[m] for m in up[n])) for n in nodes}
    strict = {(a, b) for a in nodes for b in up[a] if a not in up[b] and a != b}
    return {
        (a, b) for a, b in strict if not any((a, c) in strict and (c, b) in strict for c in nodes)
    }


@pytest.mark.parametrize("seed", range(2))
def test_direct_hierarchy(spark, seed):
    from ontomill.kb import KnowledgeBase

    rnd = random.Random(seed)
    names = [f"C{i}" for i in range(9)]
    sub = sorted({(a, b) for a, b in (rnd.sample(names, 2) for _ in range(11))})
    kb = KnowledgeBase.from_rows(spark, subclass_of_class=sub, equivalent_to_class=[("C1", "Q")])
    direct = rows(hierarchy.direct_superclasses(kb))
    assert direct == _brute_direct(set(sub) | {("C1", "Q"), ("Q", "C1")})
    assert rows(hierarchy.inferred_subclasses(kb)) == direct - set(sub)


def test_from_files_to_answers(spark, tmp_path):
    (tmp_path / "abox").mkdir()
    parts = {
        "abox/one.nt": ":x :p :y\n:y rdf:type :B\n:y rdf:type :C",
        "tbox.nt": (
            ":p rdf:type owl:ObjectProperty\n:A owl:equivalentClass _:s\n_:s owl:onProperty :p\n"
            "_:s owl:someValuesFrom _:i\n_:i owl:intersectionOf _:c1\n_:c1 rdf:first :B\n"
            "_:c1 rdf:rest _:c2\n_:c2 rdf:first :C\n_:c2 rdf:rest rdf:nil"
        ),
    }
    for name, text in parts.items():
        lines = format_ntriples(triples(spark, text)).collect()
        (tmp_path / name).write_text("\n".join(r.value for r in lines) + "\nnot a triple\n")
    built = build_kb(spark, [str(tmp_path / "abox")], [str(tmp_path / "tbox.nt")])
    assert rows(built.bad_lines) == {("not a triple",)}
    assert rows(built.bad_expressions) == set()
    members = materialise(built.kb).kb["class_individuals"].filter(f"cls = '{E}A'")
    assert short(rows(members)) == {(":A", ":x")}
    write_answers(members, str(tmp_path / "answers"))
    assert rows(spark.read.text(str(tmp_path / "answers"))) == {(f"{E}A\t{E}x",)}


def test_axiom_counts(spark):
    both = triples(spark, INDIVIDUALS + ONTOLOGY.strip() + "\n" + EXPRESSIONS.strip())
    counts = dict(row_list(axiom_counts(both)))
    assert counts["ClassAssertion"] == 5
    assert counts["EquivalentClasses"] == 5
    assert counts["SubClassOf"] == 3
    assert counts["Declaration"] == 4
    assert counts["DataPropertyAssertion"] == 1
    assert counts["SameIndividual"] == 1


def test_escapes_are_decoded_and_written_again(spark):
    lines = [
        "<http://x/\\u00e9> <http://p> <http://x/\\U0001F600> .",
        "<http://x/é> <http://p> <http://x/😀> .",
        "<http://x/a\\u0020b> <http://p> \"\\u0041\\u0022\\t\\\\u0041\\n\"@en .",
        "\t<http://x/a\\u0020b>\t<http://p>\t\"A\\\"\t\\\\u0041\\n\"@en.",
        "<http://x/\\uD83D> <http://p> <http://o> .",
        "<http://x/\\n> <http://p> <http://o> .",
        "<http://x> <http://p> \"\\x\" .",
        "<http://x> <http://p> \"\\U00110000\" .",
    ]
    found, rejects = parse_ntriples(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(found) == {
        ("http://x/é", "http://p", "http://x/😀"),
        ("http://x/a b", "http://p", '"A\\"\t\\\\u0041\\n"@en'),
    }
    assert rows(rejects) == {(x,) for x in lines[4:]}
    written = format_ntriples(found)
    assert any("<http://x/a\\u0020b>" in r.value for r in written.collect())
    assert rows(parse_ntriples(written)[0]) == rows(found)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1


def test_a_restriction_without_a_property_is_rejected(spark):
    from ontomill.sources.class_expressions import Chains, decompose, list_cells

    lines = [
        "<A> <http://www.w3.org/2000/01/rdf-schema#subClassOf> _:x .",
        "_:x <http://www.w3.org/2002/07/owl#someValuesFrom> <B> .",
    ]
    triples = parse_ntriples(spark.createDataFrame([(x,) for x in lines], "value string"))[0]
    parts = decompose(triples)
    assert rows(parts.kb["subclass_of_some"]) == set()
    assert rows(parts.rejects) == {("A", "_:x")}


def test_order_lines_are_numbered_once_for_all_triples(spark):
    from ontomill.sources import warehouse_ontology

    triples = warehouse_ontology.expressions(spark, "/root/testdata/sf0.001")
    plan = triples._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_links_of_one_property_are_not_gathered_in_one_place(spark, tmp_path):
    links = spark.range(20_000).selectExpr("concat('a', id) AS s", "'p' AS p", "concat('b', id) AS o")
    stated = links.unionByName(triples(spark, ":p rdf:type owl:ObjectProperty").selectExpr("'p' AS s", "p", "o"))
    stated.write.parquet(str(tmp_path / "stated"))
    stated = spark.read.parquet(str(tmp_path / "stated"))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "10000")  # the triples are far larger, the properties are not
    try:
        found = axioms.property_assertions(stated, axioms.object_properties(stated))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(prop#\d+, \d+", plan)
        assert found.count() == 20_000
    finally:
        spark.conf.set(threshold, before)


def test_white_space_around_lines(spark):
    text = [" \t<a> <b> <c> . \r", "\n\n<a> <b> <d> .\n", "  ", "\t# note", "\nx\ny\nz", " <a> <b> ."]
    found, rejects = parse_ntriples(spark.createDataFrame([(v,) for v in text], "value string"))
    assert rows(found) == {("a", "b", "c"), ("a", "b", "d")}
    assert rows(rejects) == {("\nx\ny\nz",), (" <a> <b> .",)}
    # Triples are not trimmed a second time beside the match.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("trim(") <= 1


def test_lists_are_followed_from_wanted_heads_only(spark):
    t = triples(
        spark,
        """
        _:a1 rdf:first :x
        _:a1 rdf:rest _:a2
        _:a2 rdf:first :y
        _:a2 rdf:rest _:a3
        _:a3 rdf:first :z
        _:a3 rdf:rest rdf:nil
        _:b1 rdf:first :x
        _:b1 rdf:rest _:b2
        _:b2 rdf:first :y
        _:b2 rdf:rest _:gone
        """,
    )
    chains = Chains(list_cells(t).withColumnRenamed("expr", "cell"), Scratch(spark))
    assert not chains.shared
    alone = {("_:b1", "_:b1"), ("_:b2", "_:b1")}
    assert rows(chains.heads()) == alone | {("_:a1", "_:a1"), ("_:a2", "_:a1"), ("_:a3", "_:a1")}
    wanted = spark.createDataFrame([("_:b1",)], "head string")
    assert rows(chains.heads(wanted)) == alone
    merged = t.unionByName(triples(spark, "_:c1 rdf:first :w\n_:c1 rdf:rest _:a2"))
    chains = Chains(list_cells(merged).withColumnRenamed("expr", "cell"), Scratch(spark))
    assert chains.shared
    assert ("_:a3", "_:c1") in rows(chains.heads()) and ("_:a3", "_:a1") in rows(chains.heads())

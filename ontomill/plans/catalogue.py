"""Every rule, loader, closure, count and pattern query over the warehouse tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontomill.kb import KnowledgeBase
from ontomill.operators import hierarchy, stats
from ontomill.operators.bgp import Link, Type, Var, asked_of, bgp
from ontomill.operators.closure import same_as_groups
from ontomill.operators.joins import insert_new, union_all
from ontomill.operators.rules import RULES
from ontomill.plans.fixpoint import materialise
from ontomill.schema import FACT_TABLES
from ontomill.sources import axioms, warehouse_ontology
from ontomill.sources.class_expressions import decompose
from ontomill.sources.ntriples import parse_ntriples
from ontomill.sources.warehouse import (
    passages_kb,
    restrictions_kb,
    split_kb,
    table,
    warehouse_kb,
)

Query = Callable[[SparkSession, str], DataFrame]

X, Y, Z = Var("x"), Var("y"), Var("z")
# name -> (patterns, answer, whether over the materialised knowledge base)
PATTERNS: dict[str, tuple[list, Var, bool]] = {
    "bgp_q1": ([Type(X, "Prio_1"), Link(X, "placedBy", "cust:0")], X, False),
    "bgp_q2": ([Type(X, "Customer")], X, True),
    "bgp_q3": ([Type(X, "Seg_BUILDING"), Link(X, "inNation", "nation:0")], X, False),
    "bgp_q4": (
        [
            Type(X, "Status_O"),
            Link(X, "placedBy", Y),
            Type(Y, "Seg_BUILDING"),
            Link(Y, "inNation", "nation:0"),
        ],
        X,
        False,
    ),
    "bgp_q6": ([Type(Y, "Part"), Link("order:1", "containsPart", Y)], Y, True),
    "bgp_q8": ([Type(Y, "Type_PROMO"), Link("order:3", "containsPart", Y)], Y, False),
    "bgp_q9": (
        [
            Type(X, "Prio_1"),
            Link(X, "placedBy", Y),
            Link(Y, "inNation", Z),
            Link(Z, "inRegion", "region:0"),
        ],
        X,
        False,
    ),
    "bgp_q12": ([Link(X, "placedBy", Y), Link(Y, "inNation", "nation:0")], X, False),
}


def _with_copies_equal(spark: SparkSession, sf_dir: str) -> KnowledgeBase:
    """The base knowledge base, with equal documents linked by the hasContent rule."""
    kb = warehouse_kb(spark, sf_dir)
    return kb.replace(same_as=RULES["inverse_functional_property"](kb))


def _rule(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if name == "same_as_transitive_closure":
            return same_as_groups(_with_copies_equal(spark, sf_dir)["same_as"])
        needs_same = name.startswith("same_as")
        kb = (_with_copies_equal if needs_same else warehouse_kb)(spark, sf_dir)
        return RULES[name](kb)

    return run


def _table(name: str) -> Query:
    return lambda spark, sf_dir: warehouse_kb(spark, sf_dir)[name].dropDuplicates()


def _materialised(name: str) -> Query:
    """A table of the closed knowledge base; what no rule leads from to it is not derived."""
    return lambda spark, sf_dir: materialise(
        warehouse_kb(spark, sf_dir), wanted={name: None}
    ).kb[name]


def _continued(name: str) -> Query:
    """The knowledge base closed in two steps: customers and some axioms come later."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        known, later = split_kb(spark, sf_dir)
        return materialise(materialise(known), added=later).kb[name]

    return run


def _chains(name: str) -> Query:
    """Closed over chains of equal documents; only the rules for equal individuals apply."""
    rules = {"inverse_functional_property", "same_as_class_individual", "same_as_prop_individual"}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kb = passages_kb(spark, sf_dir)
        return materialise(kb, rules=rules, same_as_closure=True).kb[name]

    return run


def _groups_over_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_as_groups(RULES["inverse_functional_property"](passages_kb(spark, sf_dir)))


def _pattern(name: str) -> Query:
    patterns, answer, over_all = PATTERNS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kb = warehouse_kb(spark, sf_dir)
        closed = materialise(kb, wanted=asked_of(patterns)).kb if over_all else kb
        return bgp(closed, patterns, [answer])

    return run


def _new_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = warehouse_kb(spark, sf_dir)
    derived = RULES["subclass_of_class"](kb).unionByName(
        kb["class_individuals"].filter(F.col("cls") == "Supplier")
    )
    return insert_new(derived, kb["class_individuals"])[0]


# ---- loaders ----


def _loader(load: Callable[[DataFrame], DataFrame], *sources) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        triples = union_all([source(spark, sf_dir) for source in sources])
        return load(warehouse_ontology.through_text(triples))

    return run


def _expression(table: str, source=warehouse_ontology.expressions) -> Query:
    return _loader(lambda t: decompose(t).kb[table], source)


def _disjoint_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The disjointness rule over lists: all states, and all priorities, of orders."""
    kb = warehouse_kb(spark, sf_dir)
    classes = table(spark, sf_dir, "orders").selectExpr(
        "inline(array(struct('status' AS axiom, concat('Status_', o_orderstatus) AS cls),"
        " struct('priority' AS axiom, concat('Prio_', substr(o_orderpriority, 1, 1)) AS cls)))"
    )
    members = classes.dropDuplicates()
    negated = members.selectExpr("cls AS key", "concat('Outside_', cls) AS complement")
    return RULES["disjoint_with"](kb.replace(disjoint_members=members, complement_of=negated))


def told_hierarchy(spark: SparkSession, sf_dir: str) -> KnowledgeBase:
    triples = warehouse_ontology.through_text(warehouse_ontology.hierarchy(spark, sf_dir))
    return KnowledgeBase(
        spark,
        {
            "subclass_of_class": axioms.without_top(axioms.subclasses(triples), "supclass"),
            "equivalent_to_class": axioms.equivalent_classes(triples),
        },
    )


def told_properties(spark: SparkSession, sf_dir: str) -> KnowledgeBase:
    triples = warehouse_ontology.through_text(warehouse_ontology.properties(spark, sf_dir))
    return KnowledgeBase(
        spark,
        {
            "sub_property_of": axioms.super_properties(triples),
            "op_domain": axioms.property_domains(triples),
            "op_range": axioms.property_ranges(triples),
        },
    )


def _by_restrictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct superclasses that are not stated, through restrictions and a property chain."""
    kb, chains = restrictions_kb(spark, sf_dir)
    return hierarchy.inferred_subclasses(kb, hierarchy.inferred_superclasses(kb, chains))


def _two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members numbered in two batches: the numbers of the first stay as they are."""
    members = warehouse_kb(spark, sf_dir)["class_individuals"]
    early = stats.ordinals(members.filter("md5(individual) < '8'"), "cls", "individual")
    last = stats.last_numbers(early, "cls")
    late, _ = stats.insert_numbered(members, early, last, "cls", "individual")
    return early.unionByName(late)


def _property_assertions(triples: DataFrame) -> DataFrame:
    return axioms.property_assertions(triples, axioms.object_properties(triples))


def _loaders() -> dict[str, Query]:
    o = warehouse_ontology
    plain = {
        "load_ntriples": _loader(lambda t: t, o.facts),
        "load_class_individuals": _loader(axioms.class_assertions, o.facts),
        "load_same_as": _loader(axioms.same_individuals, o.facts),
        "load_prop_individuals": _loader(_property_assertions, o.facts),
        "load_functional_property": _loader(axioms.functional_properties, o.properties),
        "load_inverse_functional_property": _loader(
            axioms.inverse_functional_properties, o.properties
        ),
        "load_disjoint_with": _loader(axioms.disjoint_classes, o.hierarchy, o.expressions),
        "load_equivalent_to_class": _loader(axioms.equivalent_classes, o.hierarchy),
        "load_subclass_of_class": _loader(axioms.subclasses, o.hierarchy),
        "load_inverse_of": _loader(axioms.inverse_properties, o.properties),
        "load_sub_property_of": _loader(axioms.super_properties, o.properties),
        "load_equivalent_property": _loader(axioms.equivalent_properties, o.properties),
        "load_op_domain": lambda spark, d: hierarchy.inherit_domain(told_properties(spark, d)),
        "load_op_range": lambda spark, d: hierarchy.inherit_range(told_properties(spark, d)),
        "load_super_class_of": lambda spark, d: hierarchy.super_class_of(told_hierarchy(spark, d)),
        "load_inferred_subclass_of_class": lambda spark, d: hierarchy.inferred_subclasses(
            told_hierarchy(spark, d)
        ),
        "hierarchy_closure": lambda spark, d: hierarchy.class_hierarchy_closure(
            told_hierarchy(spark, d)
        ),
        "hierarchy_direct": lambda spark, d: hierarchy.direct_superclasses(
            told_hierarchy(spark, d)
        ),
        "load_disjoint_members": _loader(lambda t: axioms.disjoint_lists(t)[0], o.expressions),
        "load_expression_domain": _loader(axioms.property_domains, o.more_expressions),
        "load_expression_disjoint": _loader(axioms.disjoint_classes, o.more_expressions),
        "load_escaped_ntriples": lambda s, d: parse_ntriples(o.escaped(s, d))[0].dropDuplicates(),
        "load_restricted_subclass_of_class": _by_restrictions,
        "expression_rejects_without_property": _loader(
            lambda t: decompose(t).rejects, o.bare_restrictions
        ),
        "expression_rejects": _loader(lambda t: decompose(t).rejects, o.expressions),
        "agg_axiom_counts": _loader(
            stats.axiom_counts, o.facts, o.hierarchy, o.properties, o.expressions
        ),
    }
    wanted = (
        "equivalent_to_all",
        "complement_of",
        "equivalent_to_union",
        "equivalent_to_intersection",
        "equivalent_to_max_cardinality",
        "subclass_of_some",
        "subclass_of_intersection",
        "subclass_of_min_cardinality",
        "equivalent_to_class",
        "subclass_of_class",
    )
    further = (
        "equivalent_to_some",
        "equivalent_to_min_cardinality",
        "subclass_of_all",
        "subclass_of_union",
        "subclass_of_complement",
        "subclass_of_max_cardinality",
    )
    several = {
        "expression_several_unions": _expression("equivalent_to_union", o.more_expressions),
        "expression_several_complements": _expression("complement_of", o.more_expressions),
    }
    return {
        **plain,
        **{f"expression_{t}": _expression(t) for t in wanted},
        **{f"expression_{t}": _expression(t, o.more_expressions) for t in further},
        **several,
    }


def all_queries() -> dict[str, Query]:
    return {
        "kb_class_individuals": _table("class_individuals"),
        "kb_prop_individuals": _table("prop_individuals"),
        **{f"rule_{name}": _rule(name) for name in RULES},
        "rule_disjoint_lists": _disjoint_lists,
        "same_as_groups": _groups_over_chains,
        **{
            f"fix_{name}": _materialised(table)
            for name, table in zip(
                ("class_individuals", "prop_individuals", "same_as"), FACT_TABLES, strict=True
            )
        },
        **{f"fix_continued_{name}": _continued(name) for name in FACT_TABLES},
        **{f"fix_chains_{name}": _chains(name) for name in FACT_TABLES},
        **{name: _pattern(name) for name in PATTERNS},
        "agg_class_counts": lambda s, d: stats.class_counts(warehouse_kb(s, d)),
        "agg_prop_counts": lambda s, d: stats.property_counts(warehouse_kb(s, d)),
        "agg_same_as_counts": lambda s, d: stats.same_as_counts(_with_copies_equal(s, d)),
        "win_member_ordinal": lambda s, d: stats.ordinals(
            warehouse_kb(s, d)["class_individuals"], "cls", "individual"
        ),
        "win_ordinal_two_batches": _two_batches,
        "new_facts_anti": _new_facts,
        **_loaders(),
    }

"""From triples to a knowledge base, in one program with parameters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontomill.kb import KnowledgeBase
from ontomill.operators import hierarchy
from ontomill.sources import axioms
from ontomill.sources.class_expressions import decompose
from ontomill.sources.ntriples import read_ntriples
from ontomill.sources.scratch import Scratch


@dataclass
class BuiltKB:
    """The tables, the lines that were no triples, and the expressions of no known kind."""

    kb: KnowledgeBase
    bad_lines: DataFrame
    bad_expressions: DataFrame


def build_kb(spark: SparkSession, abox: list[str], tbox: list[str]) -> BuiltKB:
    """Read individuals from the ``abox`` paths and the ontology from the ``tbox`` paths.

    Imported ontologies are further ``tbox`` paths. A data set that states axioms
    among its individuals goes into both lists.
    """
    ontology, bad_axioms = read_ntriples(spark, *tbox)
    paths = [*abox, *(path for path in tbox if path not in abox)]
    individuals, bad_facts = read_ntriples(spark, *paths)
    built = kb_from_triples(individuals, ontology)
    built.bad_lines = bad_facts.unionByName(bad_axioms).dropDuplicates()
    return built


def kb_from_triples(individuals: DataFrame, ontology: DataFrame) -> BuiltKB:
    """As ``build_kb``, from triples; ``individuals`` should include the ontology's own."""
    spark = ontology.sparkSession
    # Parsed once; the loaders then scan columns, with their predicates pushed down.
    scratch = Scratch(spark)
    individuals, ontology = scratch.cut(individuals), scratch.cut(ontology)
    parts = decompose(ontology)
    disjoint = cache(lambda: axioms.disjoint_lists(ontology))
    stated = KnowledgeBase(
        spark,
        {
            "class_individuals": axioms.class_assertions(individuals),
            "prop_individuals": axioms.property_assertions(
                individuals, axioms.object_properties(ontology)
            ),
            "same_as": axioms.same_individuals(individuals),
            "functional_property": axioms.functional_properties(ontology),
            "inverse_functional_property": axioms.inverse_functional_properties(ontology),
            "disjoint_with": axioms.disjoint_classes(ontology),
            "disjoint_members": lambda: disjoint()[0],
            "equivalent_to_class": axioms.equivalent_classes(ontology),
            "subclass_of_class": axioms.without_top(axioms.subclasses(ontology), "supclass"),
            "op_domain": axioms.property_domains(ontology),
            "op_range": axioms.property_ranges(ontology),
            "inverse_of": axioms.inverse_properties(ontology),
            "sub_property_of": axioms.super_properties(ontology),
            "equivalent_property": axioms.equivalent_properties(ontology),
        },
    ).union(parts.kb)
    direct = scratch.cut(hierarchy.inferred_superclasses(stated))
    properties = hierarchy.property_closure(stated)
    kb = stated.replace(
        subclass_of_class=stated["subclass_of_class"]
        .unionByName(hierarchy.inferred_subclasses(stated, direct))
        .dropDuplicates(),
        super_class_of=hierarchy.super_class_of(stated, direct),
        op_domain=hierarchy.inherit_domain(stated, properties),
        op_range=hierarchy.inherit_range(stated, properties),
    )
    no_lines = spark.range(0).select(F.lit(None).cast("string").alias("line"))
    return BuiltKB(kb, no_lines, parts.rejects.unionByName(disjoint()[1]).dropDuplicates())

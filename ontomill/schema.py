"""Schemas of the knowledge-base tables.

Every table is a set of rows. ``domain`` and ``range`` are individuals in
``prop_individuals`` and classes in the property-axiom and restriction tables;
``ind1`` and ``ind2`` are always classes.
"""

from __future__ import annotations

from pyspark.sql import types as T

# OWL, RDF and RDFS terms.
OWL = "http://www.w3.org/2002/07/owl#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL_THING = OWL + "Thing"
OWL_NOTHING = OWL + "Nothing"


def _table(*columns: str) -> T.StructType:
    return T.StructType(
        [T.StructField(c, T.IntegerType() if c == "card" else T.StringType()) for c in columns]
    )


TABLES: dict[str, T.StructType] = {
    # facts about individuals
    "class_individuals": _table("cls", "individual"),
    "prop_individuals": _table("prop", "domain", "range"),
    "same_as": _table("ind", "same"),
    # cls is below ...
    "subclass_of_class": _table("cls", "supclass"),
    "subclass_of_all": _table("cls", "prop", "range"),
    "subclass_of_some": _table("cls", "prop", "range"),
    "subclass_of_intersection": _table("cls", "ind1", "ind2"),
    "subclass_of_union": _table("cls", "ind1", "ind2"),
    "subclass_of_complement": _table("key", "complement"),
    "subclass_of_max_cardinality": _table("cls", "prop", "card", "clss"),
    "subclass_of_min_cardinality": _table("cls", "prop", "card", "clss"),
    "super_class_of": _table("cls", "subclass"),
    # cls is the same as ...
    "equivalent_to_class": _table("cls", "equiv"),
    "equivalent_to_all": _table("cls", "prop", "range"),
    "equivalent_to_some": _table("cls", "prop", "range"),
    "equivalent_to_intersection": _table("cls", "ind1", "ind2"),
    "equivalent_to_union": _table("cls", "ind1", "ind2"),
    "equivalent_to_max_cardinality": _table("cls", "prop", "card", "clss"),
    "equivalent_to_min_cardinality": _table("cls", "prop", "card", "clss"),
    "complement_of": _table("key", "complement"),
    "disjoint_with": _table("cls", "ind1"),
    # all classes of one axiom are disjoint with each other
    "disjoint_members": _table("axiom", "cls"),
    # property axioms
    "functional_property": _table("prop"),
    "inverse_functional_property": _table("prop"),
    "op_domain": _table("domain", "property"),
    "op_range": _table("range", "property"),
    "inverse_of": _table("prop", "inverse"),
    "sub_property_of": _table("prop", "super_prop"),
    "equivalent_property": _table("cls", "equiv"),
}

#: Tables that grow while a knowledge base is materialised.
FACT_TABLES = ("class_individuals", "prop_individuals", "same_as")
#: Tables of ontology axioms; no rule changes them.
AXIOM_TABLES = tuple(name for name in TABLES if name not in FACT_TABLES)


def columns(table: str) -> list[str]:
    return TABLES[table].fieldNames()

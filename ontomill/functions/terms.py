"""Column functions over RDF triples.

In a triples table, ``s``, ``p`` and ``o`` are strings: an IRI without its angle
brackets, a blank node as ``_:name``, or a literal with its quotes as written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontomill.schema import OWL, RDF, RDFS

RDF_TYPE = RDF + "type"

# Declaration types, and predicates with the axiom they state.
DECLARATIONS = (
    OWL + "Class",
    OWL + "ObjectProperty",
    OWL + "DatatypeProperty",
    OWL + "AnnotationProperty",
    OWL + "NamedIndividual",
    RDFS + "Datatype",
)
PROPERTY_TRAITS = {
    OWL + "FunctionalProperty": "FunctionalProperty",
    OWL + "InverseFunctionalProperty": "InverseFunctionalProperty",
    OWL + "TransitiveProperty": "TransitiveProperty",
    OWL + "SymmetricProperty": "SymmetricProperty",
}
AXIOM_PREDICATES = {
    RDFS + "subClassOf": "SubClassOf",
    OWL + "equivalentClass": "EquivalentClasses",
    OWL + "disjointWith": "DisjointClasses",
    RDFS + "subPropertyOf": "SubPropertyOf",
    OWL + "equivalentProperty": "EquivalentProperties",
    OWL + "inverseOf": "InverseProperties",
    RDFS + "domain": "PropertyDomain",
    RDFS + "range": "PropertyRange",
    OWL + "sameAs": "SameIndividual",
    OWL + "differentFrom": "DifferentIndividuals",
}
ANNOTATIONS = (RDFS + "label", RDFS + "comment", RDFS + "seeAlso", OWL + "versionInfo")
# Predicates that only describe the inside of an axiom.
PARTS = (
    RDF + "first",
    RDF + "rest",
    OWL + "onProperty",
    OWL + "someValuesFrom",
    OWL + "allValuesFrom",
    OWL + "onClass",
    OWL + "unionOf",
    OWL + "intersectionOf",
    OWL + "complementOf",
    OWL + "minCardinality",
    OWL + "maxCardinality",
    OWL + "minQualifiedCardinality",
    OWL + "maxQualifiedCardinality",
    OWL + "imports",
)


def is_blank(term: str) -> Column:
    return F.col(term).startswith("_:")


def is_literal(term: str) -> Column:
    return F.col(term).startswith('"')


def is_vocabulary(term: str) -> Column:
    """Whether the term belongs to OWL, RDF or RDFS itself."""
    return F.col(term).startswith(OWL) | F.col(term).startswith(RDF) | F.col(term).startswith(RDFS)


def is_named(term: str) -> Column:
    """Whether the term is an IRI outside the ontology vocabulary."""
    return ~(is_blank(term) | is_literal(term) | is_vocabulary(term))


def axiom_type(triples: DataFrame) -> Column:
    """The kind of axiom a triple states, or null for a part of one."""
    s, p, o = triples["s"], triples["p"], triples["o"]
    kind = F.when(p.isin(*PARTS), F.lit(None))
    kind = kind.when((p == RDF_TYPE) & o.isin(*DECLARATIONS), "Declaration")
    for trait, name in PROPERTY_TRAITS.items():
        kind = kind.when((p == RDF_TYPE) & (o == trait), name)
    kind = kind.when((p == RDF_TYPE) & (o == OWL + "AllDisjointClasses"), "DisjointClasses")
    kind = kind.when((p == RDF_TYPE) & is_vocabulary("o") & (o != OWL + "Thing"), F.lit(None))
    kind = kind.when(p == RDF_TYPE, "ClassAssertion")
    for predicate, name in AXIOM_PREDICATES.items():
        # A blank subject of these belongs to the inside of another axiom.
        own = ~s.startswith("_:") if name == "InverseProperties" else F.lit(True)
        kind = kind.when((p == predicate) & own, name)
    kind = kind.when(p == OWL + "inverseOf", F.lit(None))
    kind = kind.when(p.isin(*ANNOTATIONS), "AnnotationAssertion")
    kind = kind.when(is_vocabulary("p"), F.lit(None))
    kind = kind.when(o.startswith('"'), "DataPropertyAssertion")
    return kind.otherwise("ObjectPropertyAssertion")

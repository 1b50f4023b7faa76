"""From triples ``(s, p, o)`` to rows of the knowledge-base tables.

Class expressions (blank nodes) are taken apart in ``class_expressions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.functions.terms import RDF_TYPE, is_blank, is_named
from ontomill.operators.joins import key_join
from ontomill.schema import OWL, OWL_THING, RDF, RDFS
from ontomill.sources.class_expressions import NIL, Chains, list_cells
from ontomill.sources.scratch import Scratch

# Types that only object properties have.
OBJECT_PROPERTY_TYPES = (
    OWL + "ObjectProperty",
    OWL + "InverseFunctionalProperty",
    OWL + "TransitiveProperty",
    OWL + "SymmetricProperty",
)


def _typed(triples: DataFrame, *types: str) -> DataFrame:
    return triples.filter((F.col("p") == RDF_TYPE) & F.col("o").isin(*types))


def _links(
    triples: DataFrame, predicate: str, subject: str, object_: str, blank: str = ""
) -> DataFrame:
    """Distinct ends of ``predicate`` under the given column names.

    They are named, or blank nodes where ``blank`` has an "s" or an "o": class
    expressions, which ``class_expressions`` makes classes of their own.
    """
    rows = triples.filter(F.col("p") == predicate)
    for end in ("s", "o"):
        rows = rows.filter(is_named(end) | is_blank(end) if end in blank else is_named(end))
    return rows.select(F.col("s").alias(subject), F.col("o").alias(object_)).dropDuplicates()


def _both_ways(df: DataFrame) -> DataFrame:
    a, b = df.columns
    return df.unionByName(df.select(F.col(b).alias(a), F.col(a).alias(b))).dropDuplicates()


def class_assertions(triples: DataFrame) -> DataFrame:
    """class_individuals: named members of named classes; owl:Thing says nothing."""
    return _links(triples, RDF_TYPE, "individual", "cls").select("cls", "individual")


def same_individuals(triples: DataFrame) -> DataFrame:
    """same_as, both ways round."""
    return _both_ways(_links(triples, OWL + "sameAs", "ind", "same"))


def object_properties(triples: DataFrame) -> DataFrame:
    """Names declared as object properties, as ``(prop)``."""
    declared = _typed(triples, *OBJECT_PROPERTY_TYPES).filter(is_named("s"))
    return declared.select(F.col("s").alias("prop")).dropDuplicates()


def property_assertions(triples: DataFrame, properties: DataFrame) -> DataFrame:
    """prop_individuals: links between named individuals by one of ``properties``.

    The properties are worked out first, so that the planner knows how many there are and
    does not shuffle all links of a property to one place for the few that there mostly are.
    """
    properties, _ = Scratch(triples.sparkSession).settle(properties)
    rows = triples.filter(is_named("p") & is_named("s") & is_named("o")).select(
        F.col("p").alias("prop"), F.col("s").alias("domain"), F.col("o").alias("range")
    )
    return key_join(rows, properties, ["prop"], "left_semi").dropDuplicates()


def functional_properties(triples: DataFrame) -> DataFrame:
    return _flag(triples, OWL + "FunctionalProperty")


def inverse_functional_properties(triples: DataFrame) -> DataFrame:
    return _flag(triples, OWL + "InverseFunctionalProperty")


def _flag(triples: DataFrame, trait: str) -> DataFrame:
    """Object properties with the trait; data properties have no links to apply it to."""
    flagged = _typed(triples, trait).select(F.col("s").alias("prop")).dropDuplicates()
    return flagged.join(object_properties(triples), "prop", "left_semi")


def disjoint_classes(triples: DataFrame) -> DataFrame:
    """disjoint_with: pairs stated as such; expressions may be on either side."""
    return _links(triples, OWL + "disjointWith", "cls", "ind1", blank="so")


def disjoint_lists(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """disjoint_members: all operands of each disjointness axiom, and unusable axioms.

    A list of n classes is n rows. A list that does not come to its end is left out as a
    whole and listed as ``(key, expr)``: the axiom and the first cell.
    """
    scratch = Scratch(triples.sparkSession)
    axioms = _typed(triples, OWL + "AllDisjointClasses").select("s")
    heads = triples.filter(F.col("p") == OWL + "members").join(axioms, "s", "left_semi")
    heads = heads.select(F.col("s").alias("axiom"), F.col("o").alias("head")).dropDuplicates()
    cells = scratch.cut(list_cells(triples).withColumnRenamed("expr", "cell"))
    placed = scratch.cut(cells.join(scratch.cut(Chains(cells, scratch).heads(heads)), "cell"))
    ended = scratch.cut(placed.filter(F.col("rest") == NIL).select("head").dropDuplicates())
    whole = heads.join(ended, "head", "left_semi")
    operands = placed.filter(is_named("first") | is_blank("first")).join(whole, "head")
    broken = heads.join(ended, "head", "left_anti").filter(F.col("head") != NIL)
    return (
        operands.select("axiom", F.col("first").alias("cls")).dropDuplicates(),
        broken.select(F.col("axiom").alias("key"), F.col("head").alias("expr")),
    )


def equivalent_classes(triples: DataFrame) -> DataFrame:
    """equivalent_to_class, both ways round: between named classes, or two expressions."""
    pairs = _links(triples, OWL + "equivalentClass", "cls", "equiv", blank="so")
    return _both_ways(pairs.filter(is_blank("cls") == is_blank("equiv")))


def subclasses(triples: DataFrame) -> DataFrame:
    """subclass_of_class between named classes, or of an expression.

    Expressions above a named class have tables of their own. Below owl:Thing says
    nothing.
    """
    pairs = _links(triples, RDFS + "subClassOf", "cls", "supclass", blank="so")
    return pairs.filter(is_blank("cls") | ~is_blank("supclass"))


def property_domains(triples: DataFrame) -> DataFrame:
    """op_domain as asserted for object properties."""
    return _property_class(triples, "domain")


def property_ranges(triples: DataFrame) -> DataFrame:
    """op_range as asserted for object properties."""
    return _property_class(triples, "range")


def _property_class(triples: DataFrame, side: str) -> DataFrame:
    stated = _links(triples, RDFS + side, "property", side, blank="o").select(side, "property")
    properties = object_properties(triples).withColumnRenamed("prop", "property")
    return stated.join(properties, "property", "left_semi").select(side, "property")


def inverse_properties(triples: DataFrame) -> DataFrame:
    """inverse_of, both ways round, without properties inverse to themselves.

    A blank node that stands for "the inverse of P" is kept as a property name.
    """
    rows = triples.filter(
        (F.col("p") == OWL + "inverseOf") & (is_named("s") | is_blank("s")) & is_named("o")
    )
    pairs = rows.select(F.col("s").alias("prop"), F.col("o").alias("inverse"))
    return _both_ways(pairs.filter(F.col("prop") != F.col("inverse")))


def super_properties(triples: DataFrame) -> DataFrame:
    """sub_property_of(prop, super_prop) for object properties and inverses of such."""
    stated = _links(triples, RDFS + "subPropertyOf", "prop", "super_prop", blank="so")
    inverses = triples.filter((F.col("p") == OWL + "inverseOf") & is_blank("s"))
    inverses = inverses.select(F.col("s").alias("prop")).dropDuplicates()
    below = stated.join(object_properties(triples).unionByName(inverses), "prop", "left_semi")
    above = inverses.withColumnRenamed("prop", "super_prop")
    return below.filter(~is_blank("super_prop")).unionByName(
        below.filter(is_blank("super_prop")).join(above, "super_prop", "left_semi").select(
            "prop", "super_prop"
        )
    )


def equivalent_properties(triples: DataFrame) -> DataFrame:
    """equivalent_property, in the stated direction."""
    stated = _links(triples, OWL + "equivalentProperty", "cls", "equiv")
    properties = object_properties(triples).withColumnRenamed("prop", "cls")
    return stated.join(properties, "cls", "left_semi")


def without_top(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) != OWL_THING)

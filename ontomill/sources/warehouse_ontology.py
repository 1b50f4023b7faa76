"""The warehouse tables written as an ontology: triples for the loaders.

Customers, suppliers, parts and orders become classes, so the axioms grow with the
tables. An order is the union, the intersection or a disjoint list of its parts,
by order status; each list has one cell per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontomill.functions.terms import RDF_TYPE
from ontomill.operators.joins import key_join, union_all
from ontomill.operators.stats import number_rows
from ontomill.schema import OWL, OWL_THING, RDF, RDFS
from ontomill.sources.ntriples import format_ntriples, parse_ntriples
from ontomill.sources.scratch import Scratch
from ontomill.sources.warehouse import table

# Fixed value.
COUNT_TYPE = "http://www.w3.org/2001/XMLSchema#nonNegativeInteger"


def _n(prefix: str, *keys: str) -> Column:
    parts = [F.col(k).cast("string") for k in keys]
    return F.concat(F.lit(prefix), F.concat_ws("-", *parts))


def _t(df: DataFrame, s: Column, p: str | Column, o: str | Column) -> DataFrame:
    p = F.lit(p) if isinstance(p, str) else p
    o = F.lit(o) if isinstance(o, str) else o
    return df.select(s.alias("s"), p.alias("p"), o.alias("o"))


def _count(column: str) -> Column:
    return F.concat(F.lit('"'), F.col(column).cast("string"), F.lit(f'"^^<{COUNT_TYPE}>'))


def through_text(triples: DataFrame) -> DataFrame:
    """Turn the triples into N-Triples lines, parse those, and keep the result as a table."""
    return Scratch(triples.sparkSession).cut(parse_ntriples(format_ntriples(triples))[0])


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    documents = table(spark, sf_dir, "documents")
    order, doc = _n("order:", "o_orderkey"), _n("doc:", "doc_id")
    price = F.concat(F.lit('"'), F.col("o_totalprice").cast("string"), F.lit('"'))
    first_copy = documents.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("first"))
    copies = key_join(documents.select("doc_id", F.md5("text").alias("h")), first_copy, ["h"])
    copies = copies.filter(F.col("doc_id") != F.col("first"))
    return union_all(
        [
            _t(orders, order, RDF_TYPE, _n("Status_", "o_orderstatus")),
            _t(orders, order, RDF_TYPE, OWL_THING),
            _t(orders, order, RDF_TYPE, OWL + "NamedIndividual"),
            _t(orders, order, "placedBy", _n("cust:", "o_custkey")),
            _t(orders, order, "totalPrice", price),
            _t(orders, order, "seeAlso", _n("page:", "o_orderkey")),
            _t(documents, doc, RDF_TYPE, _n("Lang_", "lang")),
            _t(copies, doc, OWL + "sameAs", _n("doc:", "first")),
            _t(
                table(spark, sf_dir, "region"), F.lit("placedBy"), RDF_TYPE, OWL + "ObjectProperty"
            ).dropDuplicates(),
        ]
    )


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    supplier = table(spark, sf_dir, "supplier")
    part = table(spark, sf_dir, "part")
    below = RDFS + "subClassOf"
    return union_all(
        [
            _t(nation, _n("nation:", "n_nationkey"), below, _n("region:", "n_regionkey")),
            _t(table(spark, sf_dir, "region"), _n("region:", "r_regionkey"), below, OWL_THING),
            _t(customer, _n("cust:", "c_custkey"), below, _n("nation:", "c_nationkey")),
            _t(supplier, _n("supp:", "s_suppkey"), below, _n("nation:", "s_nationkey")),
            _t(
                supplier,
                _n("supp:", "s_suppkey"),
                OWL + "equivalentClass",
                _n("vendor:", "s_suppkey"),
            ),
            _t(part, _n("part:", "p_partkey"), below, _n("type:", "p_type")),
            _t(part, _n("part:", "p_partkey"), OWL + "disjointWith", _n("size:", "p_size")),
        ]
    )


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier")
    own, wide = _n("supplies:", "s_suppkey"), _n("suppliesIn:", "s_nationkey")
    national = _n("suppliesIn:", "n_nationkey")
    regional = _n("suppliesTo:", "n_regionkey")
    object_property = OWL + "ObjectProperty"
    return union_all(
        [
            _t(supplier, own, RDF_TYPE, object_property),
            _t(nation, national, RDF_TYPE, object_property),
            _t(nation, regional, RDF_TYPE, object_property),
            _t(supplier, own, RDFS + "subPropertyOf", wide),
            _t(nation, national, RDFS + "subPropertyOf", regional),
            _t(supplier, own, RDFS + "domain", _n("supp:", "s_suppkey")),
            _t(nation, national, RDFS + "domain", _n("nation:", "n_nationkey")),
            _t(nation, regional, RDFS + "range", _n("region:", "n_regionkey")),
            _t(supplier, own, OWL + "inverseOf", _n("suppliedBy:", "s_suppkey")),
            _t(supplier, own, OWL + "equivalentProperty", _n("delivers:", "s_suppkey")),
            _t(supplier, own, RDF_TYPE, OWL + "InverseFunctionalProperty"),
            _t(
                supplier.filter(F.col("s_acctbal") > 0), own, RDF_TYPE, OWL + "FunctionalProperty"
            ),
            _t(supplier, _n("hasName:", "s_suppkey"), RDF_TYPE, OWL + "FunctionalProperty"),
            _t(supplier, _n("hasName:", "s_suppkey"), RDF_TYPE, OWL + "DatatypeProperty"),
        ]
    )


def expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restrictions on customers, suppliers and parts, and the part lists of orders."""
    customer = table(spark, sf_dir, "customer")
    supplier = table(spark, sf_dir, "supplier")
    part = table(spark, sf_dir, "part")
    same, below = OWL + "equivalentClass", RDFS + "subClassOf"

    some = _n("_:some", "c_custkey")
    only, outside = _n("_:only", "s_suppkey"), _n("_:not", "s_suppkey")
    most, least = _n("_:most", "p_partkey"), _n("_:least", "p_partkey")
    odd = _n("_:odd", "p_partkey")
    restrictions = [
        _t(customer, _n("cust:", "c_custkey"), below, some),
        _t(customer, some, OWL + "onProperty", "inNation"),
        _t(customer, some, OWL + "someValuesFrom", _n("nation:", "c_nationkey")),
        _t(supplier, _n("supp:", "s_suppkey"), same, only),
        _t(supplier, only, OWL + "onProperty", "sellsTo"),
        _t(supplier, only, OWL + "allValuesFrom", outside),
        _t(supplier, outside, OWL + "complementOf", _n("nation:", "s_nationkey")),
        _t(part, _n("part:", "p_partkey"), same, most),
        _t(part, most, OWL + "onProperty", "madeOf"),
        _t(part, most, OWL + "maxCardinality", _count("p_size")),
        _t(part, _n("part:", "p_partkey"), below, least),
        _t(part, least, OWL + "onProperty", "storedIn"),
        _t(part, least, OWL + "minQualifiedCardinality", _count("p_size")),
        _t(part, least, OWL + "onClass", _n("type:", "p_type")),
        _t(part, _n("kind:", "p_partkey"), same, odd),
        _t(part, odd, OWL + "oneOf", RDF + "nil"),
    ]

    lines = table(spark, sf_dir, "lineitem")
    # Written once each, as all the triples below read them again.
    scratch = Scratch(spark)
    lines = number_rows(lines, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", total="lines")
    lines = scratch.cut(
        lines.selectExpr("l_orderkey", "l_partkey", "num AS line", "num < lines AS more")
    )
    heads = lines.filter("line = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    placed = table(spark, sf_dir, "orders").join(heads, "o_orderkey", "left_semi")
    orders = scratch.cut(placed.select("o_orderkey", "o_orderstatus"))
    cell = _n("_:cell", "l_orderkey", "line")
    after = F.concat(
        F.lit("_:cell"), F.col("l_orderkey").cast("string"), F.lit("-"), (F.col("line") + 1)
    )
    open_, done = (orders.filter(F.col("o_orderstatus") == c) for c in ("O", "F"))
    pending = orders.filter(F.col("o_orderstatus") == "P")
    order, list_ = _n("order:", "o_orderkey"), _n("_:list", "o_orderkey")
    head = F.concat(_n("_:cell", "o_orderkey"), F.lit("-1"))
    lists = [
        _t(lines, cell, RDF + "first", _n("part:", "l_partkey")),
        _t(lines, cell, RDF + "rest", F.when(F.col("more"), after).otherwise(RDF + "nil")),
        _t(open_, order, same, list_),
        _t(open_, list_, OWL + "unionOf", head),
        _t(done, order, below, list_),
        _t(done, list_, OWL + "intersectionOf", head),
        _t(pending, list_, RDF_TYPE, OWL + "AllDisjointClasses"),
        _t(pending, list_, OWL + "members", head),
    ]
    return union_all(restrictions + lists)


def more_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other kinds of restrictions, several expressions of one class, and
    expressions as a domain and in a disjointness."""
    customer = table(spark, sf_dir, "customer")
    supplier = table(spark, sf_dir, "supplier")
    part = table(spark, sf_dir, "part")
    nation = table(spark, sf_dir, "nation")
    same, below = OWL + "equivalentClass", RDFS + "subClassOf"
    cust, supp, own = _n("cust:", "c_custkey"), _n("supp:", "s_suppkey"), _n("part:", "p_partkey")
    vendor, home = _n("vendor:", "s_suppkey"), _n("nation:", "s_nationkey")
    some, least, most = _n("_:in", "c_custkey"), _n("_:ge", "p_partkey"), _n("_:le", "p_partkey")
    only, outside = _n("_:sell", "s_suppkey"), _n("_:out", "s_suppkey")
    either, site, apart = _n("_:site", "s_suppkey"), _n("_:either", "n_nationkey"), _n("_:no", "p_partkey")

    def pair(df: DataFrame, node: Column, key: str, name: str, one: Column, other: Column) -> list:
        first, second = _n(f"_:{name}a", key), _n(f"_:{name}b", key)
        return [
            _t(df, node, OWL + "unionOf", first),
            _t(df, first, RDF + "first", one),
            _t(df, first, RDF + "rest", second),
            _t(df, second, RDF + "first", other),
            _t(df, second, RDF + "rest", RDF + "nil"),
        ]

    return union_all(
        [
            _t(customer, cust, same, some),
            _t(customer, some, OWL + "onProperty", "inNation"),
            _t(customer, some, OWL + "someValuesFrom", _n("nation:", "c_nationkey")),
            _t(part, own, same, least),
            _t(part, least, OWL + "onProperty", "soldBy"),
            _t(part, least, OWL + "minCardinality", _count("p_size")),
            _t(part, own, below, most),
            _t(part, most, OWL + "onProperty", "madeOf"),
            _t(part, most, OWL + "maxCardinality", _count("p_size")),
            _t(supplier, supp, below, only),
            _t(supplier, only, OWL + "onProperty", "sellsTo"),
            _t(supplier, only, OWL + "allValuesFrom", home),
            _t(supplier, supp, below, outside),
            _t(supplier, outside, OWL + "complementOf", home),
            _t(nation, _n("nation:", "n_nationkey"), below, site),
            *pair(nation, site, "n_nationkey", "n", _n("region:", "n_regionkey"), _n("land:", "n_nationkey")),
            *pair(supplier, vendor, "s_suppkey", "v", supp, home),
            *pair(supplier, vendor, "s_suppkey", "w", supp, _n("agent:", "s_suppkey")),
            _t(supplier, vendor, OWL + "complementOf", _n("buyer:", "s_suppkey")),
            _t(supplier, _n("supplies:", "s_suppkey"), RDF_TYPE, OWL + "ObjectProperty"),
            _t(supplier, _n("supplies:", "s_suppkey"), RDFS + "domain", either),
            *pair(supplier, either, "s_suppkey", "e", supp, vendor),
            _t(part, own, OWL + "disjointWith", apart),
            _t(part, apart, OWL + "complementOf", _n("type:", "p_type")),
        ]
    )


def bare_restrictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts below a restriction that names no property, suppliers below one that does."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    bare, site = _n("_:bare", "p_partkey"), _n("_:in", "s_suppkey")
    return union_all(
        [
            _t(part, _n("part:", "p_partkey"), RDFS + "subClassOf", bare),
            _t(part, bare, OWL + "someValuesFrom", _n("type:", "p_type")),
            _t(supplier, _n("supp:", "s_suppkey"), RDFS + "subClassOf", site),
            _t(supplier, site, OWL + "onProperty", "sellsTo"),
            _t(supplier, site, OWL + "someValuesFrom", _n("nation:", "s_nationkey")),
        ]
    )


def escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines ``value`` that spell the same documents' languages in two ways each."""
    documents = table(spark, sf_dir, "documents")
    lines = [
        "concat('<doc:', doc_id, '> <lang\\\\u00E9> <Lang_', lang, '> .')",
        "concat('<doc\\\\u003A', doc_id, '> <lang\\\\U000000e9>\\t<Lang_', lang, '> . # again')",
        "concat('<doc:', doc_id, '> <label> \"\\\\u0041\\\\t\\\\u0022', lang, '\\\\u0022\"@en .')",
        "concat('<doc:', doc_id, '> <label> \"A\\t\\\\\"', lang, '\\\\\"\"@en .')",
        "concat('<doc:', doc_id, '> <label> \"\\\\uD83D\" .')",
    ]
    return documents.selectExpr(f"inline(array({', '.join(f'struct({x} AS value)' for x in lines)}))")

"""Maps the warehouse tables of TESTDATA.md to a knowledge base.

Facts come from the tables; the axioms are constants that make every rule fire.
Documents with the same text share a content node, so copies are found equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontomill.kb import KnowledgeBase
from ontomill.operators.joins import union_all
from ontomill.schema import OWL_THING

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

AXIOMS: dict[str, list[tuple]] = {
    "subclass_of_class": [(f"Seg_{s}", "Customer") for s in SEGMENTS]
    + [("Customer", "Party"), ("Supplier", "Party")]
    + [("Status_F", "Order"), ("Status_O", "Order"), ("Status_P", "Order")]
    + [("Open", "Status_O")],
    "complement_of": [
        ("NotPrio_1", "Prio_1"),
        ("NotNotPrio_1", "NotPrio_1"),
        ("NotOpen", "Status_O"),
        ("NotOpenStrict", "Open"),
        ("NotProblem", "Status_P"),
    ],
    "disjoint_with": [("Status_F", "NotProblem"), ("Supplier", "Customer")],
    "equivalent_to_all": [("Seg_BUILDING", "inNation", "BuilderNation")],
    "subclass_of_all": [("Prio_1", "containsPart", "UrgentPart")],
    "equivalent_to_class": [("Supplier", "Vendor")],
    "equivalent_to_intersection": [
        ("UrgentOpen", "Prio_1", "Status_O"),
        ("Prio_2", "HighPrio", "Actionable"),
    ],
    "subclass_of_intersection": [("Prio_5", "LowPrio", "Deferrable")],
    "equivalent_to_union": [
        ("Status_O", "OpenA", "Prio_1"),
        ("BigOrSmall", "Type_LARGE", "Type_SMALL"),
    ],
    "subclass_of_union": [("Status_F", "Prio_1", "FinishedNormal")],
    "equivalent_to_max_cardinality": [("Content", "contentOf", 1, OWL_THING)],
    "equivalent_to_min_cardinality": [("Buyer", "placedBy", 1, OWL_THING)],
    "equivalent_to_some": [
        ("EuroParty", "inRegion", "Region_EUROPE"),
        ("Seg_MACHINERY", "inNation", "IndustrialNation"),
    ],
    "subclass_of_some": [("Prio_1", "placedBy", "UrgentBuyer")],
    "functional_property": [("inNation",), ("inRegion",), ("placedBy",), ("contentOf",)],
    "inverse_functional_property": [("hasContent",)],
    "op_domain": [("Order", "placedBy")],
    "op_range": [("Part", "containsPart")],
    "equivalent_property": [("placedBy", "orderedBy")],
    "inverse_of": [("placedBy", "placed")],
    "sub_property_of": [("inNation", "locatedIn"), ("inRegion", "locatedIn")],
}


# The columns used here, so that no job has to look them up in the files.
_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_type string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int",
    "documents": "doc_id bigint, text string, lang string, source string",
    "labels": "doc_id bigint, quality int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


def _named(prefix: str, value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.concat(F.lit(prefix), value.cast("string"))


def _content() -> Column:
    return F.concat(F.lit("md5:"), F.md5("text"))


def class_individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(df: DataFrame, cls: Column, individual: Column) -> DataFrame:
        return df.select(cls.alias("cls"), individual.alias("individual"))

    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders")
    documents = table(spark, sf_dir, "documents")
    order = _id("order", "o_orderkey")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    # The classes of an order, from one scan.
    classes = F.array(
        _named("Status_", "o_orderstatus"),
        _named("Prio_", F.substring("o_orderpriority", 1, 1)),
        F.when(~urgent, F.lit("NotPrio_1")),
        F.when(urgent & (F.col("o_orderstatus") == "O"), F.lit("NotNotPrio_1")),
        F.when(F.col("o_orderstatus") == "F", F.lit("NotOpen")),
    )
    order_classes = orders.select(F.explode(classes).alias("cls"), order.alias("individual"))
    order_classes = order_classes.filter("cls IS NOT NULL")
    return union_all(
        [
            rows(customer, _named("Seg_", "c_mktsegment"), _id("cust", "c_custkey")),
            rows(table(spark, sf_dir, "supplier"), F.lit("Supplier"), _id("supp", "s_suppkey")),
            rows(table(spark, sf_dir, "part"), _named("Type_", "p_type"), _id("part", "p_partkey")),
            order_classes,
            rows(
                table(spark, sf_dir, "region"),
                _named("Region_", "r_name"),
                _id("region", "r_regionkey"),
            ),
            rows(documents, _named("Lang_", "lang"), _id("doc", "doc_id")),
            rows(documents, F.lit("Content"), _content()),
            rows(
                table(spark, sf_dir, "labels"), _named("Quality_", "quality"), _id("doc", "doc_id")
            ),
        ]
    )


def prop_individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(df: DataFrame, prop: str, domain: Column, range_: Column) -> DataFrame:
        return df.select(F.lit(prop).alias("prop"), domain.alias("domain"), range_.alias("range"))

    documents = table(spark, sf_dir, "documents")
    doc = _id("doc", "doc_id")
    return union_all(
        [
            rows(
                table(spark, sf_dir, "customer"),
                "inNation",
                _id("cust", "c_custkey"),
                _id("nation", "c_nationkey"),
            ),
            rows(
                table(spark, sf_dir, "supplier"),
                "inNation",
                _id("supp", "s_suppkey"),
                _id("nation", "s_nationkey"),
            ),
            rows(
                table(spark, sf_dir, "nation"),
                "inRegion",
                _id("nation", "n_nationkey"),
                _id("region", "n_regionkey"),
            ),
            rows(
                table(spark, sf_dir, "orders"),
                "placedBy",
                _id("order", "o_orderkey"),
                _id("cust", "o_custkey"),
            ),
            rows(
                table(spark, sf_dir, "lineitem"),
                "containsPart",
                _id("order", "l_orderkey"),
                _id("part", "l_partkey"),
            ),
            rows(documents, "hasContent", doc, _content()),
            rows(documents, "contentOf", _content(), doc),
            rows(documents, "fromSource", doc, _id("src", "source")),
        ]
    )


def warehouse_kb(spark: SparkSession, sf_dir: str) -> KnowledgeBase:
    axioms = KnowledgeBase.from_rows(spark, **AXIOMS)
    return axioms.replace(
        class_individuals=lambda: class_individuals(spark, sf_dir),
        prop_individuals=lambda: prop_individuals(spark, sf_dir),
    )


def passages_kb(spark: SparkSession, sf_dir: str) -> KnowledgeBase:
    """Documents that open or end alike are equal, so equality runs over chains of them."""
    documents = table(spark, sf_dir, "documents").filter("text is not null")
    doc = _id("doc", "doc_id")
    ends = {"opensWith": F.substring("text", 1, 40), "endsWith": F.expr("right(text, 40)")}
    links = [
        documents.select(F.lit(prop).alias("prop"), doc.alias("domain"), F.md5(end).alias("range"))
        for prop, end in ends.items()
    ]
    source = documents.select(
        F.lit("fromSource").alias("prop"), doc.alias("domain"), _id("src", "source").alias("range")
    )
    members = documents.select(_named("Lang_", "lang").alias("cls"), doc.alias("individual"))
    return KnowledgeBase.from_rows(
        spark, inverse_functional_property=[(prop,) for prop in ends]
    ).replace(class_individuals=members, prop_individuals=union_all([*links, source]))


#: Axioms that ``split_kb`` adds later, with the tables they are in.
LATER_AXIOMS = ("sub_property_of", "op_domain", "equivalent_to_intersection", "functional_property")


def split_kb(spark: SparkSession, sf_dir: str) -> tuple[KnowledgeBase, KnowledgeBase]:
    """The warehouse knowledge base in two: all but customers, and customers with some axioms."""
    whole = warehouse_kb(spark, sf_dir)
    members, links = whole["class_individuals"], whole["prop_individuals"]
    later_member = F.col("individual").startswith("cust:")
    later_link = F.col("domain").startswith("cust:")
    known = {name: rows for name, rows in AXIOMS.items() if name not in LATER_AXIOMS}
    later = {name: AXIOMS[name] for name in LATER_AXIOMS}
    return (
        KnowledgeBase.from_rows(spark, **known).replace(
            class_individuals=members.filter(~later_member), prop_individuals=links.filter(~later_link)
        ),
        KnowledgeBase.from_rows(spark, **later).replace(
            class_individuals=members.filter(later_member), prop_individuals=links.filter(later_link)
        ),
    )


def restrictions_kb(spark: SparkSession, sf_dir: str) -> tuple[KnowledgeBase, DataFrame]:
    """Orders, customers and nations as classes that restrictions tie together, and a chain.

    An order is placed by a customer, who is in a nation of a region; that the order is sold
    in the region, shipped to the nation, and urgent there if so marked, is not stated.
    """
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")

    def rows(df: DataFrame, *values: Column | str, names: tuple[str, ...]) -> DataFrame:
        values = [F.lit(v) if isinstance(v, str) else v for v in values]
        return df.select(*[v.alias(n) for v, n in zip(values, names, strict=True)])

    some, steps = ("cls", "prop", "range"), ("cls", "supclass")
    order, buyer = _id("order", "o_orderkey"), _id("cust", "c_custkey")
    here, land = _id("region", "r_regionkey"), _id("nation", "n_nationkey")
    sold = _named("SoldIn_", "r_regionkey")
    priority = _named("Prio_", F.substring("o_orderpriority", 1, 1))
    tables = {
        "subclass_of_class": rows(nation, land, _id("region", "n_regionkey"), names=steps).unionByName(
            rows(orders, order, priority, names=steps)
        ),
        "subclass_of_some": rows(
            customer, buyer, "inNation", _id("nation", "c_nationkey"), names=some
        ).unionByName(rows(orders, order, "placedBy", _id("cust", "o_custkey"), names=some)),
        "equivalent_to_some": union_all(
            [
                rows(region, _named("Resident_", "r_regionkey"), "locatedIn", here, names=some),
                rows(region, sold, "placedBy", _named("Resident_", "r_regionkey"), names=some),
                rows(nation, _named("ShipsTo_", "n_nationkey"), "shipsTo", land, names=some),
            ]
        ),
        "equivalent_to_intersection": rows(
            region, _named("Rush_", "r_regionkey"), "Prio_1", sold, names=("cls", "ind1", "ind2")
        ),
    }
    axioms = KnowledgeBase.from_rows(
        spark, sub_property_of=[("inNation", "locatedIn")], op_domain=[("Party", "inNation")]
    )
    chains = spark.createDataFrame(
        [("placedBy", "inNation", "shipsTo")], "first string, second string, whole string"
    )
    return axioms.replace(**tables), chains

"""Class expressions, from blank nodes to rows of the restriction tables.

An expression is a blank node with triples such as ``owl:someValuesFrom``. Stated
of a named class, it becomes a row under that class; used inside another
expression it becomes a row under its own blank node, which serves as a fresh class
name equivalent to it. A list of operands is nested to the right: each cell with a
next cell is one row of its first operand and the remainder, whose name is the next
cell, or the last operand itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontomill.functions.terms import is_blank, is_named
from ontomill.kb import KnowledgeBase
from ontomill.operators.joins import key_join, union_all
from ontomill.schema import OWL, OWL_THING, RDF, RDFS, columns
from ontomill.sources.scratch import Scratch

NIL = RDF + "nil"
#: Fixed value: the literals that are taken as a number, of nine digits at most.
WHOLE_NUMBER = r'^"\s*\+?0*(\d{1,9})\s*"(\^\^.*|@.*)?$'

# The predicate that makes a node an expression of each kind.
KINDS = {
    "all": (OWL + "allValuesFrom",),
    "some": (OWL + "someValuesFrom",),
    "complement": (OWL + "complementOf",),
    "union": (OWL + "unionOf",),
    "intersection": (OWL + "intersectionOf",),
    "min_cardinality": (OWL + "minCardinality", OWL + "minQualifiedCardinality"),
    "max_cardinality": (OWL + "maxCardinality", OWL + "maxQualifiedCardinality"),
}
EQUIVALENT = {
    "all": "equivalent_to_all",
    "some": "equivalent_to_some",
    "complement": "complement_of",
    "union": "equivalent_to_union",
    "intersection": "equivalent_to_intersection",
    "min_cardinality": "equivalent_to_min_cardinality",
    "max_cardinality": "equivalent_to_max_cardinality",
}
SUBCLASS = {
    "all": "subclass_of_all",
    "some": "subclass_of_some",
    "complement": "subclass_of_complement",
    "union": "subclass_of_union",
    "intersection": "subclass_of_intersection",
    "min_cardinality": "subclass_of_min_cardinality",
    "max_cardinality": "subclass_of_max_cardinality",
}


@dataclass
class Decomposed:
    """Rows by table, and the expressions ``(key, expr)`` that could not be used.

    Operand lists are followed only when a table that needs them is asked for.
    """

    kb: KnowledgeBase
    make_rejects: Callable[[], DataFrame]

    @property
    def rejects(self) -> DataFrame:
        return self.make_rejects()


def decompose(triples: DataFrame) -> Decomposed:
    """Take apart every class expression that ``triples`` state of a class."""
    spark = triples.sparkSession
    scratch = Scratch(spark)
    expressions = scratch.cut(_expressions(triples))
    nodes = scratch.cut(list_cells(triples))
    uses = scratch.cut(_uses(triples, expressions, nodes))
    stated = scratch.cut(key_join(uses, expressions, ["expr"]))

    @cache
    def lists() -> tuple[DataFrame, DataFrame, DataFrame]:
        return _operand_rows(stated, nodes, scratch)

    def rows(table: str, side: str, kind: str) -> DataFrame:
        source = lists()[0] if kind in ("union", "intersection") else stated
        mine = source.filter((F.col("side") == side) & (F.col("kind") == kind))
        return _named_columns(mine, table).dropDuplicates()

    def single(side: str, above: str) -> DataFrame:
        mine = lists()[1].filter(F.col("side") == side)
        return mine.select(F.col("key").alias("cls"), F.col("ind1").alias(above))

    def equal() -> DataFrame:
        there = single("equivalent", "equiv")
        back = there.select(F.col("equiv").alias("cls"), F.col("cls").alias("equiv"))
        return there.unionByName(back).dropDuplicates()

    def rejects() -> DataFrame:
        unknown = key_join(uses, expressions, ["expr"], "left_anti").select("key", "expr")
        return unknown.unionByName(lists()[2]).dropDuplicates()

    tables: dict[str, Callable[[], DataFrame]] = {
        "equivalent_to_class": equal,
        "subclass_of_class": lambda: single("subclass", "supclass").dropDuplicates(),
    }
    for side, names in (("equivalent", EQUIVALENT), ("subclass", SUBCLASS)):
        for kind, table in names.items():
            tables[table] = partial(rows, table, side, kind)
    return Decomposed(KnowledgeBase(spark, tables), rejects)


def _part(*predicates: str) -> list[Column]:
    """The smallest and the largest object that a node has under some predicates."""
    value = F.when(F.col("p").isin(*predicates), F.col("o"))
    return [F.min(value), F.max(value)]


def _expressions(triples: DataFrame) -> DataFrame:
    """``(expr, kind, prop, filler, card)``: everything that is stated of a node.

    Each union, intersection and complement of a node is a row of its own. The parts of
    a restriction are put together; a node with two values of one part, without a property,
    or with a number that is none, is no expression and ends up among the rejects of what uses it.
    """
    plain = F.lit(None).cast("string")
    for kind in ("complement", "union", "intersection"):
        plain = F.when(F.col("p").isin(*KINDS[kind]), kind).otherwise(plain)
    boolean = triples.withColumn("kind", plain).filter(F.col("kind").isNotNull()).select(
        F.col("s").alias("expr"),
        "kind",
        F.lit(None).cast("string").alias("prop"),
        F.col("o").alias("filler"),
        F.lit(None).cast("int").alias("card"),
    )
    restriction = F.lit(None).cast("string")
    for kind in ("all", "some", "min_cardinality", "max_cardinality"):
        restriction = F.when(F.col("p").isin(*KINDS[kind]), kind).otherwise(restriction)
    counts = [*KINDS["min_cardinality"], *KINDS["max_cardinality"]]
    fillers = [*KINDS["all"], *KINDS["some"], OWL + "onClass"]
    parts = {
        "kind": [F.min(restriction), F.max(restriction)],
        "prop": _part(OWL + "onProperty"),
        "filler": _part(*fillers),
        "digits": _part(*counts),
    }
    ends = [c.alias(f"{n}_{i}") for n, pair in parts.items() for i, c in enumerate(pair)]
    whole = (
        triples.filter(F.col("p").isin(*counts, *fillers, OWL + "onProperty"))
        .groupBy(F.col("s").alias("expr"))
        .agg(*ends)
        .filter(F.col("kind_0").isNotNull())
    )
    for name in parts:
        whole = whole.filter(F.col(f"{name}_0").eqNullSafe(F.col(f"{name}_1")))
    digits = F.regexp_extract("digits_0", WHOLE_NUMBER, 1)
    card = F.when(digits != "", digits.cast("int"))
    restrictions = whole.select(
        "expr",
        F.col("kind_0").alias("kind"),
        F.col("prop_0").alias("prop"),
        F.coalesce("filler_0", F.lit(OWL_THING)).alias("filler"),
        card.alias("card"),
    ).filter(~F.col("kind").endswith("cardinality") | F.col("card").isNotNull())
    restrictions = restrictions.filter(F.col("prop").isNotNull())
    return boolean.dropDuplicates().unionByName(restrictions)


def list_cells(triples: DataFrame) -> DataFrame:
    """``(expr, first, rest)``: list cells with one operand and one next cell.

    Triples are dealt by cell first: nearly no two in a task are of one cell, so putting them
    together before the shuffle would only sort them once more.
    """
    first, rest = _part(RDF + "first"), _part(RDF + "rest")
    found = (
        triples.filter(F.col("p").isin(RDF + "first", RDF + "rest"))
        .select(F.col("s").alias("expr"), "p", "o")
        .repartition("expr")
        .groupBy("expr")
        .agg(first[0].alias("first"), first[1].alias("_f"), rest[0].alias("rest"), rest[1].alias("_r"))
    )
    return found.filter("first = _f and rest = _r").drop("_f", "_r")


def _uses(triples: DataFrame, expressions: DataFrame, cells: DataFrame) -> DataFrame:
    """``(key, expr, side)``: what each expression is stated of.

    Class axioms state it of a named class; an expression inside another is stated
    of itself, and one written directly on a named class is stated of that class. So is
    one that is a domain or range, disjoint with something, or itself below a class.
    """

    def stated(predicate: str, cls: str, expr: str, side: str) -> DataFrame:
        rows = triples.filter((F.col("p") == predicate) & is_named(cls) & is_blank(expr))
        return rows.select(
            F.col(cls).alias("key"), F.col(expr).alias("expr"), F.lit(side).alias("side")
        )

    def alone(end: str, other: Column, *predicates: str) -> DataFrame:
        rows = triples.filter(F.col("p").isin(*predicates) & is_blank(end) & other)
        expr = F.col(end)
        return rows.select(expr.alias("key"), expr.alias("expr"), F.lit("equivalent").alias("side"))

    anything = F.lit(True)
    below, disjoint, same = RDFS + "subClassOf", OWL + "disjointWith", OWL + "equivalentClass"
    # What a union or intersection points at is a list, not an expression.
    filler = F.when(~F.col("kind").isin("union", "intersection"), F.col("filler"))
    inner = expressions.select(filler.alias("expr")).unionByName(
        cells.select(F.col("first").alias("expr"))
    )
    inner = inner.filter(is_blank("expr")).dropDuplicates()
    direct = expressions.filter(is_named("expr")).select("expr").dropDuplicates()
    return union_all(
        [
            stated(OWL + "equivalentClass", "s", "o", "equivalent"),
            stated(OWL + "equivalentClass", "o", "s", "equivalent"),
            stated(RDFS + "subClassOf", "s", "o", "subclass"),
            inner.select(F.col("expr").alias("key"), "expr", F.lit("equivalent").alias("side")),
            direct.select(F.col("expr").alias("key"), "expr", F.lit("equivalent").alias("side")),
            alone("o", anything, RDFS + "domain", RDFS + "range", disjoint),
            alone("s", anything, disjoint, below),
            alone("o", is_blank("s"), below, same),
            alone("s", is_blank("o"), same),
        ]
    ).dropDuplicates()


def _operand_rows(
    stated: DataFrame, nodes: DataFrame, scratch: Scratch
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, single, broken)``: nested operand pairs, one-operand lists, unusable lists."""
    heads = stated.filter(F.col("kind").isin("union", "intersection")).select(
        "key", "expr", "side", "kind", F.col("filler").alias("head")
    )
    cells = nodes.filter(F.col("first").isNotNull() & F.col("rest").isNotNull()).select(
        F.col("expr").alias("cell"), "first", "rest"
    )
    chains = Chains(cells, scratch)
    # A cell, its operand, and the name of what comes after it (null at the end).
    last = chains.steps.filter((F.col("rest") == NIL) & F.col("here")).select(
        "cell",
        F.col("first").alias("ind1"),
        F.lit(None).cast("string").alias("ind2"),
        F.lit(False).alias("cut_short"),
        F.lit(True).alias("last"),
    )
    linked = chains.steps.filter(F.col("head").isNotNull()).select(
        F.col("head").alias("cell"),
        F.col("head_first").alias("ind1"),
        F.when(F.col("rest") == NIL, F.col("first"))
        .when(F.col("rest").isNotNull(), F.col("cell"))
        .alias("ind2"),
        F.col("here").isNull().alias("cut_short"),
        F.lit(False).alias("last"),
    )
    placed = scratch.cut(linked.unionByName(last).join(chains.heads(), "cell"))
    if chains.shared:
        # A list that never ends runs into a ring; it is left out and reported.
        ended = placed.filter("last or cut_short").select("head").dropDuplicates()
        placed = scratch.cut(placed.join(ended, "head", "left_semi"))
    listed = key_join(placed, heads, ["head"])
    pair = listed.filter(F.col("ind2").isNotNull())
    outer = pair.filter(F.col("cell") == F.col("head")).select("key", "side", "kind", "ind1", "ind2")
    inner = pair.filter(F.col("cell") != F.col("head")).select(
        F.col("cell").alias("key"), F.lit("equivalent").alias("side"), "kind", "ind1", "ind2"
    )
    single = listed.filter(F.col("ind2").isNull() & ~F.col("cut_short"))
    single = single.filter(F.col("cell") == F.col("head")).select("key", "side", "kind", "ind1")
    lost = heads.join(placed.select("head").dropDuplicates(), "head", "left_anti")
    broken = lost.select("key", "expr").unionByName(
        listed.filter("cut_short").select("key", "expr")
    )
    return outer.unionByName(inner).dropDuplicates(), single.dropDuplicates(), broken


class Chains:
    """The lists that cells ``(cell, first, rest)`` make up.

    ``steps`` has a row for each cell and the cell before it, ``head``, with that one's
    operand; a cell without one before has a null there, and a next cell that is none has no
    ``here``. Where no cell has two before it (not ``shared``), a cell is in one list at most,
    and a list with a first cell cannot run into a ring.
    """

    def __init__(self, cells: DataFrame, scratch: Scratch):
        self.scratch = scratch
        # The last cells, which all point at rdf:nil, do not take part in the join.
        before = cells.filter(F.col("rest") != NIL).select(
            F.col("rest").alias("cell"), F.col("cell").alias("head"), F.col("first").alias("head_first")
        )
        before = before.withColumn("before", F.count(F.lit(1)).over(Window.partitionBy("cell")))
        own = cells.select("cell", "first", "rest", F.lit(True).alias("here"))
        self.steps, found = scratch.cut_figures(
            own.join(before, "cell", "full"), most="max(before)", waiting="count_if(here AND head IS NOT NULL)"
        )
        self.shared = (found["most"] or 0) > 1
        self.waiting = found["waiting"]

    def heads(self, wanted: DataFrame | None = None) -> DataFrame:
        """``(cell, head)``: the first cell of the list each cell is in.

        Every round replaces a cell's known ancestor by that one's own ancestor, so after r
        rounds all cells within 2**r steps of their first cell are placed. No list is longer
        than the number of cells, so what is left then runs in a ring. With ``wanted``, only
        lists whose first cell is in its column ``head`` are followed.
        """
        first = self.steps.filter("here AND head IS NULL").select("cell", F.col("cell").alias("head"))
        if wanted is not None:
            first = self.scratch.cut(key_join(first, wanted, ["head"], "left_semi").select("cell", "head"))
        done = [first]
        waiting = self.steps.filter("here AND head IS NOT NULL").select("cell", "head")
        reach, left = 1, self.waiting
        while reach <= 2 * self.waiting and left:
            reach *= 2
            known = union_all(done).withColumn("at_end", F.lit(True)).unionByName(
                waiting.withColumn("at_end", F.lit(False))
            )
            onward = known.select(F.col("cell").alias("head"), F.col("head").alias("above"), "at_end")
            moved = key_join(waiting, onward, ["head"]).select("cell", F.col("above").alias("head"), "at_end")
            if self.shared:  # several ways may lead to the same ancestor
                moved = moved.dropDuplicates()
            moved, found = self.scratch.cut_figures(moved, left="count_if(NOT at_end)")
            left = found["left"]
            done.append(moved.filter("at_end").select("cell", "head"))
            waiting = moved.filter(~F.col("at_end")).select("cell", "head")
        placed = union_all(done)
        return placed.dropDuplicates() if self.shared else placed


def _named_columns(rows: DataFrame, table: str) -> DataFrame:
    """The table's columns from ``key``, ``prop``, ``filler``, ``card`` and operands."""
    source = {
        "cls": "key",
        "key": "key",
        "prop": "prop",
        "range": "filler",
        "clss": "filler",
        "complement": "filler",
        "card": "card",
        "ind1": "ind1",
        "ind2": "ind2",
    }
    return rows.select([F.col(source[c]).alias(c) for c in columns(table)])

"""Materialisation: apply the rules until no fact is new.

Each stage derives facts of all three tables from the same snapshot and only from
combinations that use at least one fact of the stage before. The axioms do not
change, so they are compiled once into edges; class and property hierarchies are
closed among themselves first, which saves one pass over the facts per level.

Every stage is written into buckets over whole rows in the checkpoint folder. A
candidate is shuffled once, to drop repeats, and then meets the known facts
bucket by bucket; known facts are never shuffled for this. As rows are distinct,
their buckets are even whatever class, property or individual dominates.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontomill.kb import KnowledgeBase, local_frame
from ontomill.operators import edges as E
from ontomill.operators import kernels as K
from ontomill.operators.closure import same_as_groups
from ontomill.operators.components import Components, gather, spread, written_out
from ontomill.operators.joins import key_join, new_rows_in_buckets, union_all
from ontomill.operators.rules import RULES
from ontomill.schema import AXIOM_TABLES, FACT_TABLES, columns
from ontomill.sources.scratch import Scratch, rows_seen, sorted_buckets, watch_rows

CI, PI, SA = FACT_TABLES

#: The closed hierarchies are used while they have at most this many edges.
MAX_CLOSED_EDGES = 1_000_000

_CLASS_EDGES = {
    "complement_of": E.double_negation,
    "complement_of_second": E.contraposition,
    "disjoint_with": E.disjointness,
    "subclass_of_class": E.subclass,
    "subclass_of_intersection": E.subclass_intersection,
    "equivalent_to_class": E.equivalent_class,
    "equivalent_to_intersection": E.equivalent_intersection,
    "equivalent_to_union": E.equivalent_union,
}
_PAIR_EDGES = {
    "subclass_of_union_second": E.subclass_union,
    "equivalent_to_intersection_second": E.equivalent_intersection_whole,
    "equivalent_to_union_second": E.equivalent_union_operand,
}
_END_EDGES = {
    "object_property_domain": E.property_domain,
    "object_property_range": E.property_range,
    "equivalent_to_min_cardinality": E.min_cardinality,
}
_LINK_EDGES = {
    "object_property_inverse_of": E.inverse_property,
    "object_property_sub_property_of": E.sub_property,
    "object_property_equivalent_to_class": E.equivalent_property,
}
_GUARDED_EDGES = {
    "subclass_of_all": E.subclass_all,
    "subclass_of_some_second": E.subclass_some_functional,
    "equivalent_to_all": E.equivalent_all,
    "equivalent_to_some": E.equivalent_some,
    "equivalent_to_some_second": E.equivalent_some_functional,
}
_UNIQUE_EDGES = {
    "functional_property": E.functional,
    "inverse_functional_property": E.inverse_functional,
}
_GUARDED_UNIQUE_EDGES = {"equivalent_to_max_cardinality": E.max_cardinality}

# kind of edge -> (rules, the edge columns in the shared edge table)
_KINDS = {
    "class": (_CLASS_EDGES, {"a": "src", "dst": "dst"}),
    "pair": (_PAIR_EDGES, {"a": "c1", "b": "c2", "dst": "dst"}),
    "end": (_END_EDGES, {"a": "prop", "side": "side", "dst": "dst"}),
    "link": (_LINK_EDGES, {"a": "src", "flip": "flip", "dst": "dst"}),
    "guarded": (_GUARDED_EDGES, {"a": "cls", "b": "prop", "side": "side", "dst": "dst"}),
    "unique": (_UNIQUE_EDGES, {"a": "prop", "side": "side"}),
    "guarded_unique": (_GUARDED_UNIQUE_EDGES, {"a": "cls", "b": "prop"}),
}
_EDGE_COLUMNS = {"kind": "string", "a": "string", "b": "string", "side": "string",
                 "flip": "boolean", "dst": "string"}


_OVER_EQUALS = {"same_as_class_individual", "same_as_prop_individual"}

#: Edge sets with at most this many keys narrow the scans of facts by literal values.
MAX_KEY_VALUES = 500


@dataclass
class Edges:
    """Edges of one kind, with their rows and the values of their key columns if those are few."""

    frame: DataFrame
    values: dict[str, set[str]]
    rows: list[dict] | None = None

    def of(self, **names: set[str] | None) -> Edges | None:
        """The edges that have some of ``names`` in the key columns, or None if no edge has.

        All edges if they are many; names that are None, not being known, leave out none.
        """
        if self.rows is None:
            return self
        rows = [r for r in self.rows if all(n is None or r[c] in n for c, n in names.items())]
        return self._literal(rows) if rows else None

    def both_ways(self) -> Edges:
        """Edges of two classes, each also with the classes exchanged."""
        if self.rows is None:
            swapped = self.frame.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"), "dst")
            return Edges(self.frame.unionByName(swapped), {})
        return self._literal(self.rows + [{**r, "c1": r["c2"], "c2": r["c1"]} for r in self.rows])

    def _literal(self, rows: list[dict]) -> Edges:
        order = self.frame.columns
        named = [tuple(r[c] for c in order) for r in rows]
        frame = local_frame(self.frame.sparkSession, named, self.frame.schema)
        return Edges(frame, {c: {r[c] for r in rows} for c in self.values}, rows)

    def narrow(self, facts: DataFrame, column: str, *edge_columns: str) -> DataFrame:
        """Leave out facts whose ``column`` is no key, in the scan itself if possible."""
        if not all(c in self.values for c in edge_columns):
            return facts
        keys = sorted(set().union(*(self.values[c] for c in edge_columns)))
        return facts.filter(F.col(column).isin(keys)) if len(keys) <= MAX_KEY_VALUES else facts


@dataclass
class StageStats:
    """What a stage added to a table: candidate rows by where they come from, new rows, and
    the seconds that deriving and storing them took together."""

    stage: int
    table: str
    inserted: int
    seconds: float
    derived: dict[str, int] = field(default_factory=dict)
    planning: float = 0.0


@dataclass
class Materialised:
    """The closed knowledge base and the record of how it was reached.

    ``kb["same_as"]`` holds, besides the given pairs, links from each derived equal
    individual to the smallest one of its group and back.
    """

    kb: KnowledgeBase
    stats: list[StageStats] = field(default_factory=list)
    run: _Run | None = None

    def stats_frame(self) -> DataFrame:
        """``(stage, table, inserted, seconds)``: new rows; stage 0 is what was given."""
        rows = [(s.stage, s.table, s.inserted, s.seconds) for s in self.stats]
        return self.kb.spark.createDataFrame(
            rows, "stage int, table string, inserted long, seconds double"
        )

    def derivations(self) -> DataFrame:
        """``(stage, table, source, derived, planning)``: candidate rows, known ones and
        repeats included, by the kind of rule; ``planning`` is the time to put their plan together."""
        rows = [
            (s.stage, s.table, source, derived, s.planning)
            for s in self.stats
            for source, derived in sorted(s.derived.items())
        ]
        return self.kb.spark.createDataFrame(
            rows, "stage int, table string, source string, derived long, planning double"
        )

    def same_as_groups(self) -> DataFrame:
        """Each equal individual with the smallest individual of its group."""
        return same_as_groups(self.kb[SA])

    def close(self) -> None:
        """Delete the tables that the run wrote; neither ``kb`` nor what was continued from
        this result can be read any more."""
        if self.run is not None:
            self.run.scratch.close()


def materialise(
    kb: KnowledgeBase | Materialised,
    *,
    added: KnowledgeBase | None = None,
    rules: set[str] | None = None,
    same_as_objects: bool = False,
    same_as_closure: bool = False,
    wanted: dict[str, set[str] | None] | None = None,
    max_stages: int | None = None,
) -> Materialised:
    """Derive every fact that follows by ``rules`` (all but the sameAs closure by default).

    ``same_as_objects`` also carries links over to individuals equal to their object.
    ``same_as_closure`` follows sameAs in both directions and over chains: groups of equal
    individuals are kept up while facts are derived, all members get what is known of any,
    and ``kb["same_as"]`` links each to the smallest of its whole group and back. Where the
    rules allow, facts are only gathered at that smallest one; ``kb`` writes them out for
    all members when a table is read, which can be quadratic in the size of a group.

    ``added`` holds facts and axioms to add to ``kb``, whose facts must be closed under its
    own axioms and the same options, as those of a result are. Only combinations that use
    something added are looked at. Given a ``Materialised``, its stored tables are read where
    they are; a ``KnowledgeBase`` is stored once before.

    ``wanted`` names the fact tables that are asked for, each with the classes or properties
    asked for or None for all of them: ``{"class_individuals": {"Part"}}``. Of these the result
    holds every fact that a run without ``wanted`` holds. Facts of classes and properties that no
    chain of rules leads from to a wanted one are neither stored nor derived; what else the
    result holds is not complete, and it cannot be continued.

    There is no limit to the number of stages unless ``max_stages`` sets one; passing it
    raises, as there is no partial result.
    """
    active = set(RULES) - {"same_as_transitive_closure"} if rules is None else set(rules)
    unknown = active - set(RULES)
    if unknown:
        raise KeyError(f"unknown rules: {sorted(unknown)}")
    if "same_as_transitive_closure" in active:
        raise ValueError(
            "the sameAs closure is no rule of the loop; pass same_as_closure=True, or apply "
            "closure.same_as_closure or closure.same_as_groups to the result"
        )
    if wanted is not None and (added is not None or set(wanted) - set(FACT_TABLES)):
        raise ValueError("wanted names fact tables, of a knowledge base to which nothing is added")
    options = (frozenset(active), same_as_objects, same_as_closure)
    before = kb if isinstance(kb, Materialised) else None
    if before is not None:
        if added is None:
            raise ValueError("a materialised knowledge base is continued with something added")
        if before.run.wanted is not None:
            raise ValueError("a result that holds only what was wanted cannot be continued")
        if before.run.options != options:
            raise ValueError("a result is continued with the rules and options that it was made with")
    run = _Run(before.run.kb if before else kb, added, options, before.run if before else None, wanted)
    try:
        with sorted_buckets(run.spark):
            return run.to_the_end(max_stages)
    except BaseException:
        run.scratch.forget_tables()
        raise


#: Tables of earlier stages that a fact table may consist of; beyond, the latest are merged.
MOST_TABLES = 6


@dataclass
class _Stored:
    """One written table of a fact table; ``name`` is None if another run wrote it."""

    path: str
    table: DataFrame
    rows: int
    name: str | None
    names: set[str] | None = None  # its classes or properties, unless these are many


class _Facts:
    """One growing fact table: its written stages and the newest of them.

    Few tables make up the whole at any time: when they are more than ``MOST_TABLES``, the
    latest ones are written as one, as many as are not much smaller than those before. A row
    is thus written again a number of times that grows with the logarithm of the rows.
    """

    def __init__(self, scratch: Scratch, name: str):
        self.scratch, self.name = scratch, name
        self.stages: list[_Stored] = []
        self.attempts = 0
        self.delta_written = False

    def take_over(self, other: _Facts) -> None:
        """Begin with the tables of a finished run, as they are."""
        keys = columns(self.name)
        for n, stored in enumerate(other.stages):
            table = self.scratch.read_bucketed(
                stored.path, f"{self.name}_before_{n}", stored.table.schema, keys, other.scratch.buckets
            )
            self.stages.append(_Stored(stored.path, table, stored.rows, None, stored.names))

    def append(self, candidates: dict[str, DataFrame]) -> tuple[int, dict[str, int]]:
        """Write the candidates that are new as the next stage; return their number, and
        the number of candidates by source, counted on the way."""
        self.delta_written = False
        if not candidates:
            return 0, {}
        keys = columns(self.name)
        watched = {s: watch_rows(df.select(*keys)) for s, df in candidates.items()}
        fresh = new_rows_in_buckets(
            union_all([df for df, _ in watched.values()]), [s.table for s in self.stages]
        )
        self.attempts += 1
        label = f"{self.name}_{self.attempts}"
        fresh, kept = watch_rows(fresh)
        written = self.scratch.write_bucketed(fresh, label, keys)
        rows = rows_seen(kept)
        rows = written.count() if rows is None else rows
        derived = {source: rows_seen(seen) or 0 for source, (_, seen) in watched.items()}
        if rows:
            names = self._names_in(written)
            self.stages.append(_Stored(self.scratch.path_of(label), written, rows, label, names))
            self.delta_written = True
        return rows, derived

    def _names_in(self, table: DataFrame) -> set[str] | None:
        """The classes or properties of a table, from its first column; None if they are many."""
        if self.name == SA:
            return None
        found = table.select(columns(self.name)[0]).distinct().limit(MAX_KEY_VALUES + 1).collect()
        return {row[0] for row in found} if len(found) <= MAX_KEY_VALUES else None

    def compact(self) -> None:
        """Merge earlier stages that have become many; nothing may be about to read them."""
        earlier = self.stages[:-1] if self.delta_written else self.stages
        if len(earlier) <= MOST_TABLES:
            return
        first = len(earlier) - 2
        rows = earlier[-1].rows + earlier[-2].rows
        while first > 0 and earlier[first - 1].rows <= 2 * rows:
            first -= 1
            rows += earlier[first].rows
        keys = columns(self.name)
        self.attempts += 1
        label = f"{self.name}_{self.attempts}"
        together = self._scan(earlier[first:]).repartition(self.scratch.buckets, *keys)
        written = self.scratch.write_bucketed(together, label, keys)
        names = _all_names(earlier[first:])
        merged = _Stored(self.scratch.path_of(label), written, rows, label, names)
        self.stages = [*earlier[:first], merged, *self.stages[len(earlier) :]]
        for stored in earlier[first:]:
            if stored.name is not None:
                self.scratch.delete(stored.name)

    def _scan(self, stages: list[_Stored]) -> DataFrame | None:
        if not stages:
            return None
        paths = [s.path for s in stages]
        return self.scratch.spark.read.schema(stages[0].table.schema).parquet(*paths)

    @property
    def full(self) -> DataFrame | None:
        return self._scan(self.stages)

    @property
    def delta(self) -> DataFrame | None:
        return self._scan(self.stages[-1:]) if self.delta_written else None

    @property
    def old(self) -> DataFrame | None:
        return self._scan(self.stages[:-1] if self.delta_written else self.stages)

    @property
    def full_names(self) -> set[str] | None:
        return _all_names(self.stages)

    @property
    def delta_names(self) -> set[str] | None:
        return _all_names(self.stages[-1:] if self.delta_written else [])

    @property
    def old_names(self) -> set[str] | None:
        return _all_names(self.stages[:-1] if self.delta_written else self.stages)


def _all_names(stages: list[_Stored]) -> set[str] | None:
    """The names in all of some tables; None if those of one are not known."""
    parts = [s.names for s in stages]
    return None if None in parts else set().union(*parts)


class _Run:
    def __init__(
        self,
        kb: KnowledgeBase,
        added: KnowledgeBase | None,
        options: tuple[frozenset[str], bool, bool],
        before: _Run | None,
        wanted: dict[str, set[str] | None] | None,
    ):
        self.known, self.added, self.before, self.options = kb, added, before, options
        self.kb = kb if added is None else kb.union(added)
        self.active, self.same_as_objects, self.same_as_closure = options
        self.wanted, self.relevant = wanted, None
        self.spark: SparkSession = kb.spark
        self.scratch = Scratch(self.spark)
        self.facts = {name: _Facts(self.scratch, name) for name in FACT_TABLES}
        self.groups = Components(self.scratch)
        self.touched: DataFrame | None = None
        self.at_roots = False
        self.stats: list[StageStats] = []

    # ---- axioms ----

    def _compile_edges(self) -> None:
        """The edges of all axioms, and those of them that the added axioms brought."""
        self.edge_table, rows = self._edge_table(self.kb)
        if self.wanted is not None and (self.edge_table is None or rows is not None):
            self.relevant = _Relevant(self.wanted, self.active, rows or [])
            if rows is not None:
                rows = [r for r in rows if self.relevant.leads_on(r)]
                self.edge_table = local_frame(self.spark, rows, self.edge_table.schema)
        self.edges = self._by_kind(self.edge_table, rows)
        self.fresh_edges: dict[str, Edges] = {}
        if self.added is None or not any(self.added.has(name) for name in AXIOM_TABLES):
            return
        known = self.before.edge_table if self.before else self._edge_table(self.known)[0]
        if self.edge_table is not None:
            fresh = self.edge_table if known is None else self.edge_table.subtract(known)
            self.fresh_edges = self._by_kind(*self.scratch.settle(fresh))

    def _enough_at_roots(self) -> bool:
        """Whether facts of the smallest individual of each group stand for those of all.

        A rule must find what is known of an individual in one place. Links that are only
        moved at their domain are not known at the root of their range, nor of all members
        when they are turned round.
        """
        if not self.same_as_closure or not _OVER_EQUALS <= self.active:
            return False
        if self.same_as_objects or self.edge_table is None:
            return True
        return self.edge_table.filter("flip OR (kind = 'guarded' AND side <> 'domain')").isEmpty()

    def _edge_table(self, kb: KnowledgeBase) -> tuple[DataFrame | None, list | None]:
        parts = []
        for kind, (makers, names) in _KINDS.items():
            for rule, make in makers.items():
                if rule in self.active and kb.has(*RULES[rule].axioms):
                    parts.append(self._shared(kind, make(kb), names))
        if not parts:
            return None, None
        base, _ = self.scratch.settle(union_all(parts).dropDuplicates())
        closed = self._close_hierarchies(base)
        return self.scratch.settle(self._compose(base, closed).dropDuplicates())

    @staticmethod
    def _by_kind(table: DataFrame | None, rows: list | None) -> dict[str, Edges]:
        edges: dict[str, Edges] = {}
        if table is None:
            return edges
        if rows is None:
            kinds = {r["kind"] for r in table.select("kind").distinct().collect()}
        else:
            kinds = {r["kind"] for r in rows}
        for kind, (_, names) in _KINDS.items():
            if kind not in kinds:
                continue
            values, mine = {}, None
            if rows is not None:
                mine = [{n: r[c] for c, n in names.items()} for r in rows if r["kind"] == kind]
                values = {n: {r[n] for r in mine} for c, n in names.items() if c in ("a", "b")}
            edges[kind] = Edges(_of_kind(table, kind, names), values, mine)
        return edges

    @staticmethod
    def _shared(kind: str, df: DataFrame, names: dict[str, str]) -> DataFrame:
        values = {"kind": f"'{kind}'", **{c: f"`{n}`" for c, n in names.items()}}
        return df.selectExpr(
            *[f"CAST({values.get(c, 'NULL')} AS {t}) AS {c}" for c, t in _EDGE_COLUMNS.items()]
        )

    def _close_hierarchies(self, base: DataFrame) -> DataFrame:
        """Close class and link edges under composition, doubling path lengths each round.

        A partial closure would do: the stages finish what the edges leave out. So
        the loop stops when the closure grows too large to be handed out cheaply.
        """
        paths = base.filter("kind IN ('class', 'link')").selectExpr(
            "kind", "a", "coalesce(flip, false) AS flip", "dst"
        )
        size = -1
        while True:
            onward = paths.selectExpr("kind", "a AS dst", "flip AS flip2", "dst AS dst2")
            longer = paths.join(onward, ["kind", "dst"]).selectExpr(
                "kind", "a", "flip <> flip2 AS flip", "dst2 AS dst"
            )
            longer, rows = self.scratch.settle(paths.unionByName(longer).dropDuplicates())
            grown = longer.count() if rows is None else len(rows)
            if grown > MAX_CLOSED_EDGES:
                return paths
            paths = longer
            if grown == size:
                return paths
            size = grown

    @staticmethod
    def _compose(base: DataFrame, closed: DataFrame) -> DataFrame:
        """Carry the head of every edge up the class hierarchy, and ``end`` edges down
        the property hierarchy, so that one stage reaches all that follows directly."""
        links = closed.filter("kind = 'link'").selectExpr("a", "flip", "dst AS super")
        ups = closed.filter("kind = 'class'").selectExpr("a AS dst", "dst AS up")
        other = base.filter("kind NOT IN ('class', 'link')")
        ends = other.filter("kind = 'end'").selectExpr("kind", "a AS super", "b", "side", "dst")
        inherited = ends.join(links, "super").selectExpr(
            "kind",
            "a",
            "b",
            "CASE WHEN NOT flip THEN side WHEN side = 'domain' THEN 'range' ELSE 'domain' END"
            " AS side",
            "CAST(NULL AS BOOLEAN) AS flip",
            "dst",
        )
        other = other.unionByName(inherited)
        raised = other.join(ups, "dst").selectExpr("kind", "a", "b", "side", "flip", "up AS dst")
        hierarchy = closed.selectExpr(
            "kind", "a", "CAST(NULL AS STRING) AS b", "CAST(NULL AS STRING) AS side", "flip", "dst"
        )
        return union_all([other, raised, hierarchy])

    # ---- stages ----

    def to_the_end(self, max_stages: int | None) -> Materialised:
        with ThreadPoolExecutor(max_workers=4) as pool:
            compiling = pool.submit(self._compile_edges)
            if self.same_as_closure or self.wanted is not None:
                compiling.result()
            if self.same_as_closure:
                self.at_roots = self._enough_at_roots()
            self._begin(pool)
            compiling.result()
            stage = 0
            while True:
                stage += 1
                if max_stages is not None and stage > max_stages:
                    raise RuntimeError(f"facts are still growing after {max_stages} stages")
                list(pool.map(_Facts.compact, self.facts.values()))
                start = time.monotonic()
                plans = {
                    CI: pool.submit(self._class_candidates),
                    PI: pool.submit(self._link_candidates),
                    SA: pool.submit(self._same_candidates),
                }
                candidates = {name: plan.result() for name, plan in plans.items()}
                planning = time.monotonic() - start
                self.fresh_edges = {}
                if not self._write(pool, candidates, stage, planning):
                    return self._finish()

    def _begin(self, pool: ThreadPoolExecutor) -> None:
        """Stage 0: what is given, or, besides facts known to be closed, what is added."""

        def given(kb: KnowledgeBase) -> dict[str, dict[str, DataFrame]]:
            tables = {name: kb[name] for name in FACT_TABLES if kb.has(name)}
            if self.relevant is not None:
                tables = {n: self.relevant.among(n, df) for n, df in tables.items() if self.relevant.any_of(n)}
            return {name: {"given": df} for name, df in tables.items()}

        if self.added is None:
            self._write(pool, given(self.kb), 0)
            return
        if self.before is not None:
            if self.before.at_roots and not self.at_roots:  # the added rules need them at all members
                tables = self.before.tables()
                self._write(pool, {n: {"given": make()} for n, make in tables.items()}, 0)
                self.stats = []
            else:
                for name, facts in self.facts.items():
                    facts.take_over(self.before.facts[name])
            self.groups.parts = list(self.before.groups.parts)
        else:
            self._write(pool, given(self.known), 0)
            # The links of a closed table; its groups are the groups of the facts.
            self.stats = []
        self.touched = None
        self._write(pool, given(self.added), 0)

    def _write(self, pool: ThreadPoolExecutor, candidates: dict, stage: int, planning: float = 0.0) -> int:
        """Append to the three tables at the same time; all read the same snapshot."""

        def append(name: str) -> StageStats:
            start = time.monotonic()
            rows, derived = self.facts[name].append(candidates.get(name) or {})
            return StageStats(stage, name, rows, time.monotonic() - start, derived, planning)

        stats = list(pool.map(append, FACT_TABLES))
        self.stats += stats
        self.touched = None
        if self.same_as_closure and self.facts[SA].delta is not None:
            self.touched = self.groups.add(self.facts[SA].delta)
        return sum(s.inserted for s in stats)

    def _class_candidates(self) -> dict[str, DataFrame]:
        ci, pi, sa = (self.facts[n] for n in FACT_TABLES)
        out: dict[str, list[DataFrame]] = defaultdict(list)
        # Joins of which one side has no fact are left out, and no fact is read for them.
        if ci.delta is not None and "class" in self.edges:
            edges = self.edges["class"].of(src=ci.delta_names)
            if edges is not None:
                out["class"].append(K.class_to_class(edges.narrow(ci.delta, "cls", "src"), edges.frame))
        if ci.delta is not None and "pair" in self.edges:
            edges = self.edges["pair"]
            if ci.old is not None:  # the new member may be on either side
                edges = edges.both_ways()
            edges = edges.of(c1=ci.delta_names, c2=ci.full_names)
            if edges is not None:
                first = edges.narrow(ci.delta, "cls", "c1")
                second = edges.narrow(ci.full, "cls", "c2")
                out["pair"].append(K.class_pair_to_class(first, edges.frame, second))
        if pi.delta is not None and "end" in self.edges:
            edges = self.edges["end"].of(prop=pi.delta_names)
            if edges is not None:
                links = edges.narrow(pi.delta, "prop", "prop")
                out["end"].append(K.property_to_class(links, edges.frame))
        if "guarded" in self.edges:
            for members, links, classes, props in self._new_pairs(ci, pi):
                edges = self.edges["guarded"].of(cls=classes, prop=props)
                if edges is not None:
                    out["guarded"].append(self._guarded(members, edges, links))
        if "same_as_class_individual" in self.active:
            out["same_as"] += self._over_equals(ci, "individual", K.same_to_class)
        # Facts that were there before meet only the edges that are new.
        fresh = self.fresh_edges
        if ci.old is not None and "class" in fresh:
            edges = fresh["class"]
            out["class"].append(K.class_to_class(edges.narrow(ci.old, "cls", "src"), edges.frame))
        if ci.old is not None and "pair" in fresh:
            edges = fresh["pair"]
            first = edges.narrow(ci.old, "cls", "c1")
            second = edges.narrow(ci.old, "cls", "c2")
            out["pair"].append(K.class_pair_to_class(first, edges.frame, second))
        if pi.old is not None and "end" in fresh:
            edges = fresh["end"]
            out["end"].append(K.property_to_class(edges.narrow(pi.old, "prop", "prop"), edges.frame))
        if ci.old is not None and pi.old is not None and "guarded" in fresh:
            out["guarded"].append(self._guarded(ci.old, fresh["guarded"], pi.old))
        return _by_source(out)

    @staticmethod
    def _guarded(members: DataFrame, edges: Edges, links: DataFrame) -> DataFrame:
        members = edges.narrow(members, "cls", "cls")
        links = edges.narrow(links, "prop", "prop")
        return K.guarded_property_to_class(members, edges.frame, links)

    def _over_equals(self, facts: _Facts, end: str, step) -> list[DataFrame]:
        """Facts carried over to individuals equal to their ``end``."""
        sa, out = self.facts[SA], []
        if not self.same_as_closure:
            for known, same, _, _ in self._new_pairs(facts, sa):
                near = step(known, same).dropDuplicates()
                # Second hop: through the smallest of a group to its other members.
                out += [near, step(near, sa.full)]
            return out
        groups, carry = self.groups.table(), gather if self.at_roots else spread
        if groups is not None and facts.delta is not None:
            out.append(carry(facts.delta, groups, end))
        if self.touched is not None and facts.old is not None:
            out.append(carry(facts.old, self.touched, end))
        return out

    def _link_candidates(self) -> dict[str, DataFrame]:
        pi = self.facts[PI]
        out: dict[str, list[DataFrame]] = defaultdict(list)
        for links, edges in ((pi.delta, self.edges), (pi.old, self.fresh_edges)):
            if links is None or "link" not in edges:
                continue
            some = edges["link"].of(src=pi.delta_names if edges is self.edges else pi.old_names)
            if some is not None:
                narrowed = some.narrow(links, "prop", "src")
                out["link"].append(K.property_to_property(narrowed, some.frame))
        if "same_as_prop_individual" in self.active:
            for side in ("domain", "range") if self.same_as_objects else ("domain",):
                step = partial(K.same_to_property, side=side)
                out["same_as"] += self._over_equals(pi, side, step)
        return _by_source(out)

    def _same_candidates(self) -> dict[str, DataFrame]:
        """Links of the groups that gained a value or became known as single-valued."""
        ci, pi = self.facts[CI], self.facts[PI]
        changed = ci.delta is not None or pi.delta is not None
        if not changed and not {"unique", "guarded_unique"} & set(self.fresh_edges):
            return {}
        edges = _present(self.edges, ci.full_names, pi.full_names)
        if pi.old is None:
            whole = self._single_valued_ends(ci.full, pi.full, edges)
            return {} if whole is None else {"single_value": K.same_values(whole)}
        touching = [  # facts, and what edges they meet; a new link may be of any subject
            (x, y, {k: e for k, e in _present(self.edges, classes, props).items() if k != "unique"})
            for x, y, classes, props in self._new_pairs(ci, pi)
        ]
        if pi.delta is not None:
            touching.append((None, pi.delta, _present(self.edges, None, pi.delta_names)))
        touching.append((ci.old, pi.old, _present(self.fresh_edges, ci.old_names, pi.old_names)))
        touched, props = [], []
        for x, y, meets in touching:
            ends = self._single_valued_ends(x, y, meets)
            if ends is not None:
                touched.append(ends)
                props += [e.values.get("prop") for e in meets.values()]
        if not touched:
            return {}
        # Only groups of these properties can have changed.
        edges = _present(edges, None, None if None in props else set().union(*props))
        whole = self._single_valued_ends(ci.full, pi.full, edges)
        if whole is None:
            return {}
        group = ["prop", "side", "node"]
        whole = key_join(whole, union_all(touched).select(*group), group, "left_semi")
        return {"single_value": K.same_values(whole)}

    @staticmethod
    def _single_valued_ends(
        ci: DataFrame | None, pi: DataFrame | None, by_kind: dict[str, Edges]
    ) -> DataFrame | None:
        """Ends with one value: of single-valued properties, and of guarded subjects."""
        ends = []
        if pi is not None and "unique" in by_kind:
            edges = by_kind["unique"]
            ends.append(K.link_ends(edges.narrow(pi, "prop", "prop"), edges.frame))
        if ci is not None and pi is not None and "guarded_unique" in by_kind:
            edges = by_kind["guarded_unique"]
            members = edges.narrow(ci, "cls", "cls")
            ends.append(K.guarded_ends(members, edges.frame, edges.narrow(pi, "prop", "prop")))
        return union_all(ends) if ends else None

    @staticmethod
    def _new_pairs(a: _Facts, b: _Facts) -> list[tuple]:
        """Pairs of inputs that together cover all combinations with a new fact, each with the
        names that occur in the two."""
        pairs = [
            (a.delta, b.full, a.delta_names, b.full_names),
            (a.old, b.delta, a.old_names, b.delta_names),
        ]
        return [pair for pair in pairs if pair[0] is not None and pair[1] is not None]

    # ---- result ----

    def tables(self) -> dict[str, Callable[[], DataFrame]]:
        """The fact tables that are there, written out for all members of groups."""
        ends = {CI: ["individual"], PI: ["domain", "range"] if self.same_as_objects else ["domain"]}

        def make(name: str, facts: DataFrame) -> DataFrame:
            groups = self.groups.table() if self.at_roots and name in ends else None
            return facts if groups is None else written_out(facts, groups, ends[name])

        full = {n: f.full for n, f in self.facts.items()}
        return {n: partial(make, n, facts) for n, facts in full.items() if facts is not None}

    def _finish(self) -> Materialised:
        tables = {n: f.full for n, f in self.facts.items() if f.full is not None}
        closed = self.kb.replace(**self.tables())
        # While facts grow, the smallest value of a group may change. The links handed
        # out are those of the final groups, so they do not depend on the way there.
        # They are worked out when first asked for.
        if self.same_as_closure:
            groups = self.groups.table()
            ends = None if groups is None else groups.filter("ind <> root")
        else:
            ends = self._single_valued_ends(tables.get(CI), tables.get(PI), self.edges)
        if ends is not None:

            def links() -> DataFrame:
                if self.same_as_closure:
                    back = ends.selectExpr("root AS ind", "ind AS same")
                    same = ends.withColumnRenamed("root", "same").unionByName(back)
                else:
                    same = K.same_values(ends)
                return self.scratch.cut(same.unionByName(self.kb[SA]).dropDuplicates())

            closed = closed.replace(same_as=links)
        self.scratch.forget_tables()
        return Materialised(closed, self.stats, self)


class _Relevant:
    """The classes and properties from which a chain of rules leads to a wanted fact.

    Found backwards over the edges: what makes something relevant is relevant. Facts of equal
    individuals are exchanged, so links of single-valued properties matter to all of them.
    """

    _USES = {"class": (CI, None), "pair": (CI, CI), "end": (PI, None), "link": (PI, None),
             "guarded": (CI, PI), "unique": (PI, None), "guarded_unique": (CI, PI)}

    def __init__(self, wanted: dict[str, set[str] | None], active: frozenset[str], rows: list):
        self.every = {name for name in (CI, PI) if name in wanted and wanted[name] is None}
        self.names = {name: set(wanted.get(name) or ()) for name in (CI, PI)}
        self.equals = SA in wanted
        over = {CI: "same_as_class_individual", PI: "same_as_prop_individual"}
        rest = list(rows)
        while True:
            self.equals |= any(rule in active and self.any_of(n) for n, rule in over.items())
            used = [r for r in rest if self.leads_on(r)]
            if not used:
                return
            rest = [r for r in rest if not self.leads_on(r)]
            for row in used:
                for name, key in zip(self._USES[row["kind"]], (row["a"], row["b"]), strict=True):
                    if name is not None:
                        self.names[name].add(key)

    def leads_on(self, row) -> bool:
        """Whether what an edge derives is relevant."""
        if row["kind"] in ("unique", "guarded_unique"):
            return self.equals
        name = PI if row["kind"] == "link" else CI
        return name in self.every or row["dst"] in self.names[name]

    def any_of(self, name: str) -> bool:
        return self.equals if name == SA else name in self.every or bool(self.names[name])

    def among(self, name: str, facts: DataFrame) -> DataFrame:
        """The facts that are relevant; all of them if the names are many."""
        if name == SA or name in self.every or len(self.names[name]) > MAX_KEY_VALUES:
            return facts
        return facts.filter(F.col(columns(name)[0]).isin(sorted(self.names[name])))


def _present(
    by_kind: dict[str, Edges], classes: set[str] | None, props: set[str] | None
) -> dict[str, Edges]:
    """The single-value edges of classes and properties that occur."""
    keys = {"unique": {"prop": props}, "guarded_unique": {"cls": classes, "prop": props}}
    found = {k: by_kind[k].of(**names) for k, names in keys.items() if k in by_kind}
    return {k: edges for k, edges in found.items() if edges is not None}


def _by_source(parts: dict[str, list[DataFrame]]) -> dict[str, DataFrame]:
    return {source: union_all(frames) for source, frames in parts.items() if frames}


def _of_kind(edges: DataFrame, kind: str, names: dict[str, str]) -> DataFrame:
    return edges.filter(f"kind = '{kind}'").selectExpr(*[f"{c} AS `{n}`" for c, n in names.items()])

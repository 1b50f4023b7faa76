"""Conjunctive pattern queries over class members and property links.

    bgp(kb, [Type(x, "Student"), Link(x, "memberOf", "dept:0")], select=[x])

A term that is a ``Var`` is a variable; a plain string is a constant, and is
compared in the scan. Answers are distinct.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.kb import KnowledgeBase
from ontomill.operators.joins import key_join


@dataclass(frozen=True)
class Var:
    name: str


Term = Var | str


@dataclass(frozen=True)
class Type:
    """``member`` is in class ``cls``."""

    member: Term
    cls: str

    def rows(self, kb: KnowledgeBase) -> DataFrame:
        members = kb["class_individuals"].filter(F.col("cls") == self.cls)
        return _bind(members, [("individual", self.member)])


@dataclass(frozen=True)
class Link:
    """``subject`` is linked to ``object`` by property ``prop``."""

    subject: Term
    prop: str
    object: Term

    def rows(self, kb: KnowledgeBase) -> DataFrame:
        links = kb["prop_individuals"].filter(F.col("prop") == self.prop)
        return _bind(links, [("domain", self.subject), ("range", self.object)])


def _bind(df: DataFrame, ends: list[tuple[str, Term]]) -> DataFrame:
    names: dict[str, str] = {}
    for column, term in ends:
        if isinstance(term, str):
            df = df.filter(F.col(column) == term)
        elif term.name in names:  # the same variable at both ends
            df = df.filter(F.col(column) == F.col(names[term.name]))
        else:
            names[term.name] = column
    if not names:
        raise ValueError("a pattern needs at least one variable")
    return df.select([F.col(column).alias(name) for name, column in names.items()])


def asked_of(patterns: Sequence[Type | Link]) -> dict[str, set[str]]:
    """The classes and properties that the patterns read, by fact table."""
    asked = {
        "class_individuals": {p.cls for p in patterns if isinstance(p, Type)},
        "prop_individuals": {p.prop for p in patterns if isinstance(p, Link)},
    }
    return {table: names for table, names in asked.items() if names}


def bgp(kb: KnowledgeBase, patterns: Sequence[Type | Link], select: Sequence[Var]) -> DataFrame:
    """Distinct values of ``select`` for which all patterns hold.

    A pattern whose shared and selected variables all occur in one other pattern is
    folded into that one by a semi-join, outermost patterns first, so a tree-shaped
    query never multiplies rows. What cannot be folded is joined.
    """
    wanted = [v.name for v in select]
    tables = [p.rows(kb) for p in patterns]
    missing = set(wanted) - {c for t in tables for c in t.columns}
    if missing:
        raise ValueError(f"variables in no pattern: {sorted(missing)}")
    tables = _fold(tables, wanted)
    result = tables.pop(0)
    while tables:
        linked = next((t for t in tables if set(t.columns) & set(result.columns)), None)
        if linked is None:
            raise ValueError("the patterns are not connected by shared variables")
        tables.remove(linked)
        on = [c for c in linked.columns if c in result.columns]
        result = key_join(result, linked, on)
        needed = set(wanted).union(*(t.columns for t in tables))
        result = result.select([c for c in result.columns if c in needed])
    return result.select(*wanted).dropDuplicates()


def _fold(tables: list[DataFrame], wanted: list[str]) -> list[DataFrame]:
    tables = list(tables)
    folded = True
    while folded and len(tables) > 1:
        folded = False
        for i, leaf in enumerate(tables):
            others = tables[:i] + tables[i + 1 :]
            elsewhere = set(wanted).union(*(t.columns for t in others))
            shared = [c for c in leaf.columns if c in elsewhere]
            host = next((t for t in others if set(shared) <= set(t.columns)), None)
            if shared and host is not None:
                smaller = key_join(host, leaf, shared, "left_semi")
                tables = [smaller if t is host else t for t in others]
                folded = True
                break
    return tables

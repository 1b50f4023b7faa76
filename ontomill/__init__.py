"""Knowledge-base materialisation and conjunctive queries on Spark DataFrames."""

from ontomill.kb import KnowledgeBase
from ontomill.operators.bgp import Link, Type, Var, bgp
from ontomill.plans.build_kb import build_kb
from ontomill.plans.fixpoint import materialise

__all__ = ["KnowledgeBase", "Link", "Type", "Var", "bgp", "build_kb", "materialise"]

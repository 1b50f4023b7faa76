"""The catalogue's queries as SQL over the warehouse tables, for cross-checking.

The rules are stated here a second time, in SQL and without the shared shapes, with
every pair of equal individuals written out. Only the results for sameAs name the
links to the smallest individual.
"""

from __future__ import annotations

from ontomill.schema import OWL, OWL_THING, RDF
from ontomill.schema import columns as table_columns
from ontomill.sources.warehouse import AXIOMS

#: Stages written out for the materialised results; the last ones must add nothing.
STAGES = 4

CI = """
SELECT DISTINCT cls, individual FROM (
  SELECT 'Seg_' || c_mktsegment AS cls, 'cust:' || c_custkey AS individual FROM customer
  UNION ALL SELECT 'Supplier', 'supp:' || s_suppkey FROM supplier
  UNION ALL SELECT 'Type_' || p_type, 'part:' || p_partkey FROM part
  UNION ALL SELECT 'Status_' || o_orderstatus, 'order:' || o_orderkey FROM orders
  UNION ALL SELECT 'Prio_' || substr(o_orderpriority, 1, 1), 'order:' || o_orderkey FROM orders
  UNION ALL SELECT 'NotPrio_1', 'order:' || o_orderkey FROM orders
    WHERE o_orderpriority <> '1-URGENT'
  UNION ALL SELECT 'NotNotPrio_1', 'order:' || o_orderkey FROM orders
    WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'
  UNION ALL SELECT 'NotOpen', 'order:' || o_orderkey FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'Region_' || r_name, 'region:' || r_regionkey FROM region
  UNION ALL SELECT 'Lang_' || lang, 'doc:' || doc_id FROM documents
  UNION ALL SELECT 'Content', 'md5:' || md5(text) FROM documents
  UNION ALL SELECT 'Quality_' || quality, 'doc:' || doc_id FROM labels
)"""

PI = """
SELECT DISTINCT prop, "domain", "range" FROM (
  SELECT 'inNation' AS prop, 'cust:' || c_custkey AS "domain", 'nation:' || c_nationkey AS "range"
    FROM customer
  UNION ALL SELECT 'inNation', 'supp:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'inRegion', 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
  UNION ALL SELECT 'placedBy', 'order:' || o_orderkey, 'cust:' || o_custkey FROM orders
  UNION ALL SELECT 'containsPart', 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem
  UNION ALL SELECT 'hasContent', 'doc:' || doc_id, 'md5:' || md5(text) FROM documents
  UNION ALL SELECT 'contentOf', 'md5:' || md5(text), 'doc:' || doc_id FROM documents
  UNION ALL SELECT 'fromSource', 'doc:' || doc_id, 'src:' || source FROM documents
)"""


def _literal(value: object) -> str:
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def _axiom_ctes() -> list[str]:
    ctes = []
    for name, rows in AXIOMS.items():
        names = ", ".join(f'"{c}"' for c in table_columns(name))
        values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
        ctes.append(f"{name}({names}) AS (VALUES {values})")
    return ctes


# Each body reads ci, pi and sa; {ci}, {pi}, {sa} name the stage to read.
_ALL_VALUES = """SELECT c.{t}_range AS cls, p."range" AS individual
FROM (SELECT cls, prop, "range" AS {t}_range FROM {t}) c
JOIN {{ci}} i ON i.cls = c.cls
JOIN {{pi}} p ON p.prop = c.prop AND p."domain" = i.individual"""
_UNION_REST = """SELECT CASE WHEN u.ind1 = k.complement THEN u.ind2 ELSE u.ind1 END AS cls,
  i.individual
FROM {t} u JOIN complement_of k ON k.complement IN (u.ind1, u.ind2)
JOIN {{ci}} i ON i.cls = u.cls
JOIN {{ci}} j ON j.cls = k.key AND j.individual = i.individual"""
_ONE = f"card = 1 AND clss = '{OWL_THING}'"

RULES: dict[str, str] = {
    "complement_of": """SELECT x.complement AS cls, i.individual
FROM complement_of x JOIN complement_of y ON x.key = y.complement
JOIN {ci} i ON i.cls = y.key""",
    "complement_of_second": """SELECT a.key AS cls, i.individual
FROM subclass_of_class s JOIN complement_of a ON a.complement = s.cls
JOIN complement_of b ON b.complement = s.supclass JOIN {ci} i ON i.cls = b.key""",
    "disjoint_with": """SELECT k.complement AS cls, i.individual
FROM disjoint_with d JOIN complement_of k ON k.key = d.ind1 JOIN {ci} i ON i.cls = d.cls""",
    "object_property_domain": """SELECT d."domain" AS cls, p."domain" AS individual
FROM op_domain d JOIN {pi} p ON p.prop = d.property""",
    "object_property_inverse_of": """SELECT v.inverse AS prop, p."range" AS "domain",
  p."domain" AS "range"
FROM inverse_of v JOIN {pi} p ON p.prop = v.prop""",
    "object_property_range": """SELECT r."range" AS cls, p."range" AS individual
FROM op_range r JOIN {pi} p ON p.prop = r.property""",
    "object_property_sub_property_of": """SELECT s.super_prop AS prop, p."domain", p."range"
FROM sub_property_of s JOIN {pi} p ON p.prop = s.prop""",
    "subclass_of_class": """SELECT s.supclass AS cls, i.individual
FROM subclass_of_class s JOIN {ci} i ON i.cls = s.cls""",
    "subclass_of_all": _ALL_VALUES.format(t="subclass_of_all"),
    "subclass_of_intersection": """SELECT unnest([s.ind1, s.ind2]) AS cls, i.individual
FROM subclass_of_intersection s JOIN {ci} i ON i.cls = s.cls""",
    "subclass_of_some_second": _ALL_VALUES.format(t="subclass_of_some")
    + "\nWHERE c.prop IN (SELECT prop FROM functional_property)",
    "subclass_of_union_second": _UNION_REST.format(t="subclass_of_union"),
    "equivalent_to_all": _ALL_VALUES.format(t="equivalent_to_all"),
    "equivalent_to_class": """SELECT e.equiv AS cls, i.individual
FROM equivalent_to_class e JOIN {ci} i ON i.cls = e.cls""",
    "equivalent_to_intersection": """SELECT unnest([e.ind1, e.ind2]) AS cls, i.individual
FROM equivalent_to_intersection e JOIN {ci} i ON i.cls = e.cls""",
    "equivalent_to_intersection_second": """SELECT e.cls, i.individual
FROM equivalent_to_intersection e JOIN {ci} i ON i.cls = e.ind1
JOIN {ci} j ON j.cls = e.ind2 AND j.individual = i.individual""",
    "equivalent_to_some": """SELECT e.cls, p."domain" AS individual
FROM equivalent_to_some e JOIN {ci} i ON i.cls = e."range"
JOIN {pi} p ON p.prop = e.prop AND p."range" = i.individual""",
    "equivalent_to_some_second": _ALL_VALUES.format(t="equivalent_to_some")
    + "\nWHERE c.prop IN (SELECT prop FROM functional_property)",
    "equivalent_to_union": """SELECT e.cls, i.individual
FROM equivalent_to_union e JOIN {ci} i ON i.cls IN (e.ind1, e.ind2)""",
    "equivalent_to_union_second": _UNION_REST.format(t="equivalent_to_union"),
    "equivalent_to_max_cardinality": f"""SELECT p."range" AS ind, q."range" AS same
FROM equivalent_to_max_cardinality m JOIN {{ci}} i ON i.cls = m.cls
JOIN {{pi}} p ON p.prop = m.prop AND p."domain" = i.individual
JOIN {{pi}} q ON q.prop = m.prop AND q."domain" = i.individual AND q."range" <> p."range"
WHERE {_ONE}""",
    "equivalent_to_min_cardinality": f"""SELECT m.cls, p."domain" AS individual
FROM equivalent_to_min_cardinality m JOIN {{pi}} p ON p.prop = m.prop WHERE {_ONE}""",
    "functional_property": """SELECT p."range" AS ind, q."range" AS same
FROM functional_property f JOIN {pi} p ON p.prop = f.prop
JOIN {pi} q ON q.prop = f.prop AND q."domain" = p."domain" AND q."range" <> p."range\"""",
    "inverse_functional_property": """SELECT p."domain" AS ind, q."domain" AS same
FROM inverse_functional_property f JOIN {pi} p ON p.prop = f.prop
JOIN {pi} q ON q.prop = f.prop AND q."range" = p."range" AND q."domain" <> p."domain\"""",
    "object_property_equivalent_to_class": """SELECT e.equiv AS prop, p."domain", p."range"
FROM equivalent_property e JOIN {pi} p ON p.prop = e.cls""",
    "same_as_class_individual": """SELECT i.cls, s.same AS individual
FROM {ci} i JOIN {sa} s ON s.ind = i.individual""",
    "same_as_prop_individual": """SELECT p.prop, s.same AS "domain", p."range"
FROM {pi} p JOIN {sa} s ON s.ind = p."domain\"""",
}

_SINGLE = {
    "equivalent_to_max_cardinality": """SELECT p.prop, p."domain" AS node, p."range" AS value
FROM equivalent_to_max_cardinality m JOIN {ci} i ON i.cls = m.cls
JOIN {pi} p ON p.prop = m.prop AND p."domain" = i.individual""",
    "functional_property": """SELECT p.prop, p."domain" AS node, p."range" AS value
FROM functional_property f JOIN {pi} p ON p.prop = f.prop""",
    "inverse_functional_property": """SELECT p.prop, p."range" AS node, p."domain" AS value
FROM inverse_functional_property f JOIN {pi} p ON p.prop = f.prop""",
}


def _smallest_links(rule: str, ci: str, pi: str) -> str:
    ends = _SINGLE[rule].format(ci=ci, pi=pi)
    return f"""SELECT unnest([v.value, m.least]) AS ind, unnest([m.least, v.value]) AS same
FROM ({ends}) v JOIN (
  SELECT prop, node, min(value) AS least FROM ({ends}) GROUP BY prop, node) m
ON m.prop = v.prop AND m.node = v.node WHERE v.value <> m.least"""


def _feeds(rule: str) -> str:
    if rule in _SINGLE:
        return "sa"
    links = ("object_property_inverse_of", "object_property_sub_property_of",
             "object_property_equivalent_to_class", "same_as_prop_individual")
    return "pi" if rule in links else "ci"


_COLUMNS = {"ci": "cls, individual", "pi": 'prop, "domain", "range"', "sa": "ind, same"}


def _with(ctes: list[str], body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


def _base() -> list[str]:
    return [*_axiom_ctes(), f"ci0 AS MATERIALIZED ({CI})", f"pi0 AS MATERIALIZED ({PI})"]


def _copies_equal() -> list[str]:
    links = _smallest_links("inverse_functional_property", "ci0", "pi0")
    return [*_base(), f"sa0 AS MATERIALIZED (SELECT DISTINCT * FROM ({links}))"]


def _rule_sql(rule: str) -> str:
    if rule in _SINGLE:
        body = _smallest_links(rule, "ci0", "pi0")
        return _with(_base(), f"SELECT DISTINCT ind, same FROM ({body})")
    ctes = _copies_equal() if rule.startswith("same_as") else _base()
    body = RULES[rule].format(ci="ci0", pi="pi0", sa="sa0")
    return _with(ctes, f"SELECT DISTINCT {_COLUMNS[_feeds(rule)]} FROM ({body})")


def _stages() -> list[str]:
    ctes = [*_base(), "sa0 AS (SELECT '' AS ind, '' AS same WHERE false)"]
    for stage in range(STAGES):
        names = {t: f"{t}{stage}" for t in _COLUMNS}
        for t, cols in _COLUMNS.items():
            derived = " UNION ALL ".join(
                f"SELECT {cols} FROM ({sql.format(**names)})"
                for rule, sql in RULES.items()
                if _feeds(rule) == t
            )
            ctes.append(
                f"{t}{stage + 1} AS MATERIALIZED ("
                f"SELECT {cols} FROM {t}{stage} UNION SELECT {cols} FROM ({derived}))"
            )
    return ctes


def _last(t: str) -> str:
    return f"{t}{STAGES}"


def _fix_sql(t: str) -> str:
    if t != "sa":
        return _with(_stages(), f"SELECT {_COLUMNS[t]} FROM {_last(t)}")
    links = " UNION ALL ".join(_smallest_links(r, _last("ci"), _last("pi")) for r in _SINGLE)
    return _with(_stages(), f"SELECT DISTINCT ind, same FROM ({links})")


GROUPS = """, reach(ind, same) AS (
  SELECT ind, same FROM sa0 UNION SELECT r.ind, s.same FROM reach r JOIN sa0 s ON r.same = s.ind)
SELECT ind, min(same) AS same FROM reach GROUP BY ind"""

# Documents that open or end alike, and all that chains of them reach.
_CHAINS = [
    """d AS (SELECT 'doc:' || doc_id AS ind, lang, source, md5(substr(text, 1, 40)) AS a, md5(right(text, 40)) AS b
FROM documents WHERE text IS NOT NULL)""",
    """step(ind, same) AS (SELECT x.ind, y.ind FROM d x JOIN d y ON x.a = y.a WHERE x.ind <> y.ind
UNION SELECT x.ind, y.ind FROM d x JOIN d y ON x.b = y.b WHERE x.ind <> y.ind)""",
    """reach(ind, same) AS (
SELECT ind, same FROM step UNION SELECT r.ind, s.same FROM reach r JOIN step s ON r.same = s.ind)""",
    "g AS (SELECT ind, min(same) AS root FROM reach GROUP BY ind)",
    """p(prop, x, y) AS (SELECT 'opensWith', ind, a FROM d UNION SELECT 'endsWith', ind, b FROM d
UNION SELECT 'fromSource', ind, 'src:' || source FROM d)""",
]
_CHAIN_RESULTS = {
    "same_as_groups": "SELECT ind, root AS same FROM g",
    "fix_chains_class_individuals": """SELECT 'Lang_' || lang AS cls, ind AS individual FROM d
UNION SELECT 'Lang_' || lang, r.same FROM d JOIN reach r ON r.ind = d.ind""",
    "fix_chains_prop_individuals": """SELECT prop, x AS "domain", y AS "range" FROM p
UNION SELECT prop, r.same, y FROM p JOIN reach r ON r.ind = x""",
    "fix_chains_same_as": """SELECT ind, root AS same FROM g WHERE ind <> root
UNION SELECT root, ind FROM g WHERE ind <> root""",
}

BGP = {
    "bgp_q1": """SELECT DISTINCT a.individual AS x FROM ci0 a JOIN pi0 p ON p."domain" = a.individual
WHERE a.cls = 'Prio_1' AND p.prop = 'placedBy' AND p."range" = 'cust:0'""",
    "bgp_q2": "SELECT DISTINCT individual AS x FROM {ci} WHERE cls = 'Customer'",
    "bgp_q3": """SELECT DISTINCT a.individual AS x FROM ci0 a JOIN pi0 p ON p."domain" = a.individual
WHERE a.cls = 'Seg_BUILDING' AND p.prop = 'inNation' AND p."range" = 'nation:0'""",
    "bgp_q4": """SELECT DISTINCT a.individual AS x FROM ci0 a
JOIN pi0 p ON p."domain" = a.individual AND p.prop = 'placedBy'
JOIN ci0 b ON b.individual = p."range" AND b.cls = 'Seg_BUILDING'
JOIN pi0 q ON q."domain" = b.individual AND q.prop = 'inNation' AND q."range" = 'nation:0'
WHERE a.cls = 'Status_O'""",
    "bgp_q6": """SELECT DISTINCT a.individual AS y FROM {ci} a JOIN {pi} p ON p."range" = a.individual
WHERE a.cls = 'Part' AND p.prop = 'containsPart' AND p."domain" = 'order:1'""",
    "bgp_q8": """SELECT DISTINCT a.individual AS y FROM ci0 a JOIN pi0 p ON p."range" = a.individual
WHERE a.cls = 'Type_PROMO' AND p.prop = 'containsPart' AND p."domain" = 'order:3'""",
    "bgp_q9": """SELECT DISTINCT a.individual AS x FROM ci0 a
JOIN pi0 p ON p."domain" = a.individual AND p.prop = 'placedBy'
JOIN pi0 q ON q."domain" = p."range" AND q.prop = 'inNation'
JOIN pi0 r ON r."domain" = q."range" AND r.prop = 'inRegion' AND r."range" = 'region:0'
WHERE a.cls = 'Prio_1'""",
    "bgp_q12": """SELECT DISTINCT p."domain" AS x FROM pi0 p
JOIN pi0 q ON q."domain" = p."range" AND q.prop = 'inNation' AND q."range" = 'nation:0'
WHERE p.prop = 'placedBy'""",
}

# ---- loaders: the tables as an ontology, straight from the tables ----

_THING = f"'{OWL_THING}'"
_NIL = f"'{RDF}nil'"
_TYPE = f"'{RDF}type'"
_COUNT_TYPE = "http://www.w3.org/2001/XMLSchema#nonNegativeInteger"

_FACTS = f"""
SELECT 'order:' || o_orderkey AS s, {_TYPE} AS p, 'Status_' || o_orderstatus AS o FROM orders
UNION ALL SELECT 'order:' || o_orderkey, {_TYPE}, {_THING} FROM orders
UNION ALL SELECT 'order:' || o_orderkey, {_TYPE}, '{OWL}NamedIndividual' FROM orders
UNION ALL SELECT 'order:' || o_orderkey, 'placedBy', 'cust:' || o_custkey FROM orders
UNION ALL SELECT 'order:' || o_orderkey, 'seeAlso', 'page:' || o_orderkey FROM orders
UNION ALL SELECT 'doc:' || doc_id, {_TYPE}, 'Lang_' || lang FROM documents
UNION ALL SELECT 'doc:' || doc_id, '{OWL}sameAs', 'doc:' || first FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents)
  WHERE doc_id <> first
UNION ALL SELECT 'placedBy', {_TYPE}, '{OWL}ObjectProperty'"""

_LINES = """lines AS (
  SELECT l_orderkey AS k, 'part:' || l_partkey AS part,
    row_number() OVER w AS line, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
pairs AS (
  SELECT a.k, a.line, a.n, o_orderstatus AS status, a.part AS ind1,
    CASE WHEN a.line = 1 THEN 'order:' || a.k ELSE '_:cell' || a.k || '-' || a.line END AS cls,
    CASE WHEN b.line = b.n THEN b.part ELSE '_:cell' || b.k || '-' || b.line END AS ind2
  FROM lines a JOIN orders ON o_orderkey = a.k
  LEFT JOIN lines b ON b.k = a.k AND b.line = a.line + 1)"""

_HIERARCHY = f"""step(cls, supclass) AS (
  SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
  UNION SELECT 'cust:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION SELECT 'supp:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION SELECT 'part:' || p_partkey, 'type:' || p_type FROM part
  UNION SELECT 'supp:' || s_suppkey, 'vendor:' || s_suppkey FROM supplier
  UNION SELECT 'vendor:' || s_suppkey, 'supp:' || s_suppkey FROM supplier),
closed(cls, supclass) AS (
  SELECT cls, supclass FROM step
  UNION SELECT c.cls, s.supclass FROM closed c JOIN step s ON s.cls = c.supclass),
named AS (SELECT * FROM closed WHERE cls <> supclass AND supclass <> {_THING}),
strict AS (SELECT * FROM named EXCEPT SELECT supclass, cls FROM named),
direct AS (
  SELECT * FROM strict
  EXCEPT SELECT a.cls, b.supclass FROM strict a JOIN strict b ON a.supclass = b.cls)"""

_LOADERS = {
    "load_ntriples": f"""SELECT s, p, o FROM ({_FACTS}
UNION ALL SELECT 'order:' || o_orderkey, 'totalPrice', '"' || o_totalprice || '"' FROM orders)""",
    "load_class_individuals": """SELECT 'Status_' || o_orderstatus AS cls,
  'order:' || o_orderkey AS individual FROM orders
UNION SELECT 'Lang_' || lang, 'doc:' || doc_id FROM documents""",
    "load_same_as": f"""WITH f AS ({_FACTS}), e AS (SELECT * FROM f WHERE p = '{OWL}sameAs')
SELECT s AS ind, o AS same FROM e UNION SELECT o, s FROM e""",
    "load_prop_individuals": """SELECT DISTINCT 'placedBy' AS prop, 'order:' || o_orderkey AS "domain",
  'cust:' || o_custkey AS "range" FROM orders""",
    "load_functional_property": """SELECT DISTINCT 'supplies:' || s_suppkey AS prop FROM supplier
WHERE s_acctbal > 0""",
    "load_inverse_functional_property": """SELECT DISTINCT 'supplies:' || s_suppkey AS prop
FROM supplier""",
    "load_disjoint_with": """SELECT DISTINCT 'part:' || p_partkey AS cls, 'size:' || p_size AS ind1
FROM part""",
    "load_disjoint_members": """SELECT DISTINCT '_:list' || l_orderkey AS axiom, 'part:' || l_partkey AS cls
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'""",
    "load_expression_domain": """SELECT DISTINCT '_:site' || s_suppkey AS "domain",
  'supplies:' || s_suppkey AS property FROM supplier""",
    "load_expression_disjoint": """SELECT DISTINCT 'part:' || p_partkey AS cls, '_:no' || p_partkey AS ind1
FROM part""",
    "expression_equivalent_to_some": """SELECT DISTINCT 'cust:' || c_custkey AS cls, 'inNation' AS prop,
  'nation:' || c_nationkey AS "range" FROM customer""",
    "expression_equivalent_to_min_cardinality": f"""SELECT DISTINCT 'part:' || p_partkey AS cls,
  'soldBy' AS prop, p_size AS card, {_THING} AS clss FROM part""",
    "expression_subclass_of_all": """SELECT DISTINCT 'supp:' || s_suppkey AS cls, 'sellsTo' AS prop,
  'nation:' || s_nationkey AS "range" FROM supplier""",
    "expression_subclass_of_union": """SELECT DISTINCT 'nation:' || n_nationkey AS cls,
  'region:' || n_regionkey AS ind1, 'land:' || n_nationkey AS ind2 FROM nation""",
    "expression_subclass_of_complement": """SELECT DISTINCT 'supp:' || s_suppkey AS key,
  'nation:' || s_nationkey AS complement FROM supplier""",
    "expression_subclass_of_max_cardinality": f"""SELECT DISTINCT 'part:' || p_partkey AS cls,
  'madeOf' AS prop, p_size AS card, {_THING} AS clss FROM part""",
    "expression_several_unions": """SELECT 'vendor:' || s_suppkey AS cls, 'supp:' || s_suppkey AS ind1,
  'nation:' || s_nationkey AS ind2 FROM supplier
UNION SELECT 'vendor:' || s_suppkey, 'supp:' || s_suppkey, 'agent:' || s_suppkey FROM supplier
UNION SELECT '_:site' || s_suppkey, 'supp:' || s_suppkey, 'vendor:' || s_suppkey FROM supplier""",
    "expression_several_complements": """SELECT 'vendor:' || s_suppkey AS key,
  'buyer:' || s_suppkey AS complement FROM supplier
UNION SELECT '_:no' || p_partkey, 'type:' || p_type FROM part""",
    "load_equivalent_to_class": """SELECT 'supp:' || s_suppkey AS cls, 'vendor:' || s_suppkey AS equiv
FROM supplier UNION SELECT 'vendor:' || s_suppkey, 'supp:' || s_suppkey FROM supplier""",
    "load_subclass_of_class": """SELECT 'nation:' || n_nationkey AS cls,
  'region:' || n_regionkey AS supclass FROM nation
UNION SELECT 'cust:' || c_custkey, 'nation:' || c_nationkey FROM customer
UNION SELECT 'supp:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
UNION SELECT 'part:' || p_partkey, 'type:' || p_type FROM part""",
    "load_inverse_of": """SELECT 'supplies:' || s_suppkey AS prop, 'suppliedBy:' || s_suppkey AS inverse
FROM supplier UNION SELECT 'suppliedBy:' || s_suppkey, 'supplies:' || s_suppkey FROM supplier""",
    "load_sub_property_of": """SELECT 'supplies:' || s_suppkey AS prop,
  'suppliesIn:' || s_nationkey AS super_prop FROM supplier
UNION SELECT 'suppliesIn:' || n_nationkey, 'suppliesTo:' || n_regionkey FROM nation""",
    "load_equivalent_property": """SELECT DISTINCT 'supplies:' || s_suppkey AS cls,
  'delivers:' || s_suppkey AS equiv FROM supplier""",
    "load_op_domain": """SELECT 'supp:' || s_suppkey AS "domain", 'supplies:' || s_suppkey AS property
FROM supplier UNION SELECT 'nation:' || n_nationkey, 'suppliesIn:' || n_nationkey FROM nation
UNION SELECT 'nation:' || s_nationkey, 'supplies:' || s_suppkey FROM supplier
JOIN nation ON n_nationkey = s_nationkey""",
    "load_op_range": """SELECT 'region:' || n_regionkey AS "range", 'suppliesTo:' || n_regionkey AS property
FROM nation UNION SELECT 'region:' || n_regionkey, 'suppliesIn:' || n_nationkey FROM nation
UNION SELECT 'region:' || n_regionkey, 'supplies:' || s_suppkey FROM supplier
JOIN nation ON n_nationkey = s_nationkey""",
    "hierarchy_closure": f"WITH RECURSIVE {_HIERARCHY} SELECT cls, supclass FROM named",
    "hierarchy_direct": f"WITH RECURSIVE {_HIERARCHY} SELECT cls, supclass FROM direct",
    "load_super_class_of": f"""WITH RECURSIVE {_HIERARCHY}
SELECT supclass AS cls, cls AS subclass FROM direct""",
    "load_inferred_subclass_of_class": f"""WITH RECURSIVE {_HIERARCHY}
SELECT cls, supclass FROM direct EXCEPT
(SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
  UNION SELECT 'cust:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION SELECT 'supp:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION SELECT 'part:' || p_partkey, 'type:' || p_type FROM part)""",
    "expression_rejects_without_property": """SELECT DISTINCT 'part:' || p_partkey AS key,
  '_:bare' || p_partkey AS expr FROM part""",
    "load_escaped_ntriples": """SELECT 'doc:' || doc_id AS s, 'langé' AS p, 'Lang_' || lang AS o FROM documents
UNION SELECT 'doc:' || doc_id, 'label', '"A' || chr(9) || '\\"' || lang || '\\""@en' FROM documents""",
    "load_restricted_subclass_of_class": """WITH c AS (
  SELECT c_custkey, n_nationkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
r AS (SELECT c.* FROM c JOIN region ON r_regionkey = n_regionkey),
o AS (SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS prio, r.* FROM orders JOIN r ON c_custkey = o_custkey)
SELECT 'cust:' || c_custkey AS cls, 'Party' AS supclass FROM customer
UNION SELECT 'cust:' || c_custkey, 'Resident_' || n_regionkey FROM r
UNION SELECT 'order:' || o_orderkey, 'ShipsTo_' || n_nationkey FROM o
UNION SELECT 'order:' || o_orderkey, CASE WHEN prio = '1' THEN 'Rush_' ELSE 'SoldIn_' END || n_regionkey FROM o
UNION SELECT 'Rush_' || r_regionkey, unnest(['Prio_1', 'SoldIn_' || r_regionkey]) FROM region""",
    "expression_rejects": """SELECT DISTINCT 'kind:' || p_partkey AS key, '_:odd' || p_partkey AS expr
FROM part""",
    "expression_equivalent_to_all": """SELECT DISTINCT 'supp:' || s_suppkey AS cls, 'sellsTo' AS prop,
  '_:not' || s_suppkey AS "range" FROM supplier""",
    "expression_complement_of": """SELECT DISTINCT '_:not' || s_suppkey AS key,
  'nation:' || s_nationkey AS complement FROM supplier""",
    "expression_equivalent_to_union": f"""WITH {_LINES}
SELECT DISTINCT cls, ind1, ind2 FROM pairs WHERE status = 'O' AND ind2 IS NOT NULL""",
    "expression_equivalent_to_intersection": f"""WITH {_LINES}
SELECT DISTINCT cls, ind1, ind2 FROM pairs
WHERE status = 'F' AND line > 1 AND ind2 IS NOT NULL""",
    "expression_subclass_of_intersection": f"""WITH {_LINES}
SELECT DISTINCT cls, ind1, ind2 FROM pairs
WHERE status = 'F' AND line = 1 AND ind2 IS NOT NULL""",
    "expression_equivalent_to_class": f"""WITH {_LINES}
SELECT cls, ind1 AS equiv FROM pairs WHERE status = 'O' AND n = 1
UNION SELECT ind1, cls FROM pairs WHERE status = 'O' AND n = 1""",
    "expression_subclass_of_class": f"""WITH {_LINES}
SELECT DISTINCT cls, ind1 AS supclass FROM pairs WHERE status = 'F' AND n = 1""",
    "expression_equivalent_to_max_cardinality": f"""SELECT DISTINCT 'part:' || p_partkey AS cls,
  'madeOf' AS prop, p_size AS card, {_THING} AS clss FROM part""",
    "expression_subclass_of_some": """SELECT DISTINCT 'cust:' || c_custkey AS cls, 'inNation' AS prop,
  'nation:' || c_nationkey AS "range" FROM customer""",
    "expression_subclass_of_min_cardinality": """SELECT DISTINCT 'part:' || p_partkey AS cls,
  'storedIn' AS prop, p_size AS card, 'type:' || p_type AS clss FROM part""",
    "agg_axiom_counts": f"""WITH {_LINES},
f AS (SELECT DISTINCT * FROM ({_FACTS})),
c(axiom_type, n) AS (
  SELECT 'ClassAssertion', count(*) FROM f WHERE p = {_TYPE}
    AND (o NOT LIKE '{OWL}%' OR o = {_THING})
  UNION ALL SELECT 'Declaration', (SELECT count(*) FROM f WHERE p = {_TYPE}
    AND o IN ('{OWL}NamedIndividual', '{OWL}ObjectProperty'))
    + (SELECT count(DISTINCT s_suppkey) * 2 FROM supplier)
    + (SELECT count(DISTINCT n_nationkey) + count(DISTINCT n_regionkey) FROM nation)
  UNION ALL SELECT 'SameIndividual', count(*) FROM f WHERE p = '{OWL}sameAs'
  UNION ALL SELECT 'ObjectPropertyAssertion', count(*) FROM f WHERE p IN ('placedBy', 'seeAlso')
  UNION ALL SELECT 'DataPropertyAssertion', count(*) FROM orders
  UNION ALL SELECT 'SubClassOf', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)
    + (SELECT count(*) FROM customer) * 2 + (SELECT count(*) FROM supplier)
    + (SELECT count(*) FROM part) * 2 + (SELECT count(*) FROM pairs WHERE line = 1 AND status = 'F')
  UNION ALL SELECT 'EquivalentClasses', (SELECT count(*) FROM supplier) * 2
    + (SELECT count(*) FROM part) * 2 + (SELECT count(*) FROM pairs WHERE line = 1 AND status = 'O')
  UNION ALL SELECT 'DisjointClasses', (SELECT count(*) FROM part)
    + (SELECT count(*) FROM pairs WHERE line = 1 AND status = 'P')
  UNION ALL SELECT 'SubPropertyOf', (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation)
  UNION ALL SELECT 'PropertyDomain', (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation)
  UNION ALL SELECT 'PropertyRange', count(DISTINCT n_regionkey) FROM nation
  UNION ALL SELECT 'InverseProperties', count(*) FROM supplier
  UNION ALL SELECT 'EquivalentProperties', count(*) FROM supplier
  UNION ALL SELECT 'InverseFunctionalProperty', count(*) FROM supplier
  UNION ALL SELECT 'FunctionalProperty', (SELECT count(*) FROM supplier)
    + (SELECT count(*) FROM supplier WHERE s_acctbal > 0))
SELECT axiom_type, CAST(n AS BIGINT) AS n FROM c WHERE n > 0""",
}


def all_sql() -> dict[str, str]:
    last = {"ci": _last("ci"), "pi": _last("pi")}
    patterns = {
        name: _with(_stages() if "{ci}" in body else _base(), body.format(**last))
        for name, body in BGP.items()
    }
    return {
        "kb_class_individuals": _with(_base(), "SELECT cls, individual FROM ci0"),
        "kb_prop_individuals": _with(_base(), 'SELECT prop, "domain", "range" FROM pi0'),
        **{f"rule_{rule}": _rule_sql(rule) for rule in RULES},
        "rule_disjoint_lists": _with(
            [
                *_base(),
                """m(axiom, cls) AS (SELECT 'status', 'Status_' || o_orderstatus FROM orders
  UNION SELECT 'priority', 'Prio_' || substr(o_orderpriority, 1, 1) FROM orders)""",
            ],
            """SELECT 'Outside_' || m.cls AS cls, i.individual
FROM disjoint_with d JOIN m ON m.cls = d.ind1 JOIN ci0 i ON i.cls = d.cls
UNION SELECT 'Outside_' || b.cls, i.individual FROM m a JOIN m b ON a.axiom = b.axiom AND a.cls <> b.cls
JOIN ci0 i ON i.cls = a.cls""",
        ),
        **{
            name: "WITH RECURSIVE " + ",\n".join(_copies_equal()) + GROUPS
            for name in ("rule_same_as_transitive_closure",)
        },
        **{name: _with(_CHAINS, body) for name, body in _CHAIN_RESULTS.items()},
        "fix_class_individuals": _fix_sql("ci"),
        "fix_prop_individuals": _fix_sql("pi"),
        "fix_same_as": _fix_sql("sa"),
        # In two steps or in one, the result is the same.
        "fix_continued_class_individuals": _fix_sql("ci"),
        "fix_continued_prop_individuals": _fix_sql("pi"),
        "fix_continued_same_as": _fix_sql("sa"),
        **patterns,
        "agg_class_counts": _with(_base(), "SELECT cls, count(*) AS n FROM ci0 GROUP BY cls"),
        "agg_prop_counts": _with(_base(), "SELECT prop, count(*) AS n FROM pi0 GROUP BY prop"),
        "agg_same_as_counts": _with(
            _copies_equal(), "SELECT ind, count(*) AS n FROM sa0 GROUP BY ind"
        ),
        "win_member_ordinal": _with(
            _base(),
            """SELECT cls, individual, CAST(row_number() OVER (
  PARTITION BY cls ORDER BY individual) AS BIGINT) AS num FROM ci0""",
        ),
        "win_ordinal_two_batches": _with(
            _base(),
            """SELECT cls, individual, CAST(row_number() OVER (PARTITION BY cls, late ORDER BY individual)
  + CASE WHEN late THEN count(*) FILTER (NOT late) OVER (PARTITION BY cls) ELSE 0 END AS BIGINT) AS num
FROM (SELECT *, md5(individual) >= '8' AS late FROM ci0)""",
        ),
        "new_facts_anti": _with(
            _base(),
            f"""SELECT cls, individual FROM ({RULES["subclass_of_class"].format(ci="ci0")}
UNION SELECT cls, individual FROM ci0 WHERE cls = 'Supplier')
EXCEPT SELECT cls, individual FROM ci0""",
        ),
        **_LOADERS,
    }




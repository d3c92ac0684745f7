"""Queries that run a whole bundle: pages rendered from the driver's tables, judged under a law, as they stand and against a base."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.plans import artifacts
from scriptorium.plans import law as L
from scriptorium.plans import projections as P
from scriptorium.plans.bundle import Bundle
from scriptorium.plans.catalog import _query

CUSTOMER = """
type: customer
role: concept
description: A customer, with its orders as claims.
fields:
  type: object
  properties:
    nation: { $ref: "#/$defs/page-ref", target_type: nation }
    segment: { enum: [BUILDING, HOUSEHOLD, MACHINERY, FURNITURE] }
    balance: { type: number, minimum: 0 }
  required: [nation]
sections:
  ordered: true
  additional: refused
  list:
    - { heading: Facts, min: 1, grammar: claims, provenance: required, vocabulary: states }
    - { heading: Links, grammar: relations, require: [{ labels: [in], min: 1 }] }
rules:
  - { id: rich, expr: "page.fields.balance <= 9000.0", severity: warning, message: a large balance }
  - { id: many-orders, section: Facts, expr: "section.items.size() <= 12", message: many orders }
"""
FILES = {
    "config/engine.json": json.dumps({"label": "customers", "content_roots": ["wiki"]}),
    "constitution/types/customer.yaml": CUSTOMER,
    "constitution/types/nation.yaml": "type: nation\nrole: concept\ndescription: A nation.\ninstances: { max: 20 }\n",
    "constitution/vocabularies/states.yaml": "vocabulary: states\nmode: registered\nentries: { o: null, f: null }\nretired: { p: { successor: o } }\n",
    "constitution/vocabularies/tags.yaml": "vocabulary: tags\nmode: registered\nentries: { building: null, household: null, machinery: null, automobile: null }\n",
}


def _bundle(spark: SparkSession, sf_dir: str, based: bool) -> Bundle:
    """Customers and nations as pages. Some customers have an unknown type, name a nation that no page is, lack their facts or have a section too many.

    With a base: some customers are new, some had another tag or a fact more, NATION_3 had another name, and a page NATION_99 is gone.
    """
    k, lit = F.col("c_custkey"), F.lit
    line = F.concat(F.when(F.col("o_totalprice") > 450000, "- order ").otherwise(F.concat(lit("- ["), F.lower("o_orderstatus"), lit("] order "))), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderpriority") != "1-URGENT", F.concat(lit(" (https://orders.example/"), F.col("o_orderkey").cast("string"), lit(")"))).otherwise(""), lit("\n"))
    orders = P.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", line.alias("line")).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "").alias("facts"))
    rows = P.table(spark, sf_dir, "customer").join(orders, k == F.col("o_custkey"), "left")
    nation = F.concat(lit("NATION_"), F.when(k % 13 == 5, "99").otherwise(F.col("c_nationkey").cast("string")))

    def page(tag: Column, first: Column) -> Column:
        front = F.concat(lit("---\ntype: "), F.when(k % 11 == 3, "client").otherwise("customer"), lit("\nnation: "), nation, lit("\nsegment: "), F.col("c_mktsegment"), lit("\nbalance: "), F.col("c_acctbal").cast("string"), lit("\ntags: ["), tag, lit("]\n---\n\n"))
        facts = F.when(k % 19 == 4, "").otherwise(F.concat(lit("## Facts\n\n"), first, F.coalesce("facts", lit("")), lit("\n")))
        return F.concat(front, facts, lit("## Links\n\n- in [["), nation, lit("]]\n"), F.when(k % 17 == 6, "\n## Odd\n").otherwise("")).cast("binary")

    path = F.concat(lit("wiki/customer/"), k.cast("string"), lit(".md"))
    tag = F.lower("c_mktsegment")
    none = lit(None).cast("string").alias("renamed_from")
    was = page(F.when(k % 7 == 2, "building").otherwise(tag), F.when(k % 5 == 3, "- [o] a first order (https://orders.example/first)\n").otherwise(""))
    state = rows.select(path.alias("path"), page(tag, lit("")).alias("content"), F.when(k % 9 != 1, was).alias("base_content"), none)
    own = lit("---\ntype: nation\n---\n").cast("binary")
    at = F.concat(lit("wiki/nation/"), F.col("n_name"), lit(".md"))
    state = state.union(P.table(spark, sf_dir, "nation").select(at, own, own, F.when(F.col("n_nationkey") == 3, "wiki/nation/Old name.md")))
    law = L.load(L.Snapshot("", {p: t.encode() for p, t in FILES.items()}))
    gone = spark.createDataFrame([("wiki/nation/NATION_99.md", bytearray(b"---\ntype: nation\n---\n"))], "path string, content binary")
    return Bundle(spark, "", state if based else state.select("path", "content"), law, skipped=[], removed=gone if based else None)


#: Rows of findings (k, rule, severity, kind): what a finding stands on decides how the gate takes it.
_FOUND = """c_ AS MATERIALIZED (SELECT c_custkey AS k, 'wiki/customer/' || c_custkey || '.md' AS path, c_mktsegment AS seg, c_acctbal AS bal, c_custkey % 11 <> 3 AS known, c_custkey % 19 <> 4 AS facts, c_custkey % 13 = 5 AS lost FROM customer),
o_ AS MATERIALIZED (SELECT k, path, lower(o_orderstatus) AS s, o_orderpriority = '1-URGENT' AS urgent, o_totalprice > 450000 AS odd FROM orders JOIN c_ ON o_custkey = k WHERE known AND facts),
r_ AS MATERIALIZED (
  SELECT k, path, 'type-unknown' AS rule, 'error' AS severity, 'page' AS kind FROM c_ WHERE NOT known
  UNION ALL SELECT k, path, 'page-shape-invalid', 'error', 'line' FROM c_ WHERE known AND seg = 'AUTOMOBILE' UNION ALL SELECT k, path, 'page-shape-invalid', 'error', 'line' FROM c_ WHERE known AND bal < 0
  UNION ALL SELECT k, path, 'page-ref-type', 'error', 'name' FROM c_ WHERE known AND lost
  UNION ALL SELECT k, path, 'wikilink-unresolved', 'warning', 'name' FROM c_ WHERE known AND lost UNION ALL SELECT k, path, 'relation-target-unresolved', 'warning', 'name' FROM c_ WHERE known AND lost
  UNION ALL SELECT k, path, 'vocabulary-unknown', 'error', 'tag' FROM c_ WHERE known AND seg = 'FURNITURE'
  UNION ALL SELECT k, path, 'section-count', 'error', 'page' FROM c_ WHERE known AND NOT facts
  UNION ALL SELECT k, path, 'section-undeclared', 'error', 'line' FROM c_ WHERE known AND k % 17 = 6
  UNION ALL SELECT k, path, 'rich', 'warning', 'page' FROM c_ WHERE known AND bal > 9000
  UNION ALL SELECT k, path, 'vocabulary-retired', 'error', 'line' FROM o_ WHERE NOT odd AND s = 'p' UNION ALL SELECT k, path, 'claim-provenance', 'error', 'line' FROM o_ WHERE NOT odd AND urgent
  UNION ALL SELECT k, path, 'item-unparsed', 'error', 'line' FROM o_ WHERE odd
  UNION ALL SELECT k, path, 'many-orders', 'error', 'section' FROM o_ WHERE NOT odd GROUP BY k, path HAVING count(*) > 12)"""


@_query(f"""WITH {_FOUND} SELECT path, rule, severity, count(*) AS n FROM r_ GROUP BY ALL UNION ALL SELECT '', 'instances-max', 'error', 1""")
def q64_bundle_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of a bundle of customers and nations, counted by page and code."""
    found = _bundle(spark, sf_dir, False).findings().filter("rule <> 'unevaluated'")
    return found.groupBy("path", "rule", "severity").agg(F.count("*").alias("n"))


@_query(f"""WITH {_FOUND}, n_ AS (SELECT count(*) AS all_, count(*) FILTER (known) AS own FROM c_), m_ AS (SELECT count(*) AS n FROM nation)
SELECT rule, CASE rule WHEN 'wikilink-unresolved' THEN own + n ELSE CASE WHEN rule = 'claims-transition' THEN 0 ELSE own END END AS evaluated, CASE rule WHEN 'wikilink-unresolved' THEN all_ - own ELSE all_ - own + n END AS not_applicable,
CASE WHEN rule = 'claims-transition' THEN own ELSE 0 END AS unevaluated FROM n_, m_, unnest(['rich', 'many-orders', 'wikilink-unresolved', 'claims-transition']) AS u(rule)""")
def q65_bundle_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On how many pages a code was judged, doesn't apply or couldn't be judged: an own rule, a section rule, a code of all types, a comparison without a base."""
    bundle = _bundle(spark, sf_dir, False)
    return bundle.coverage(bundle.findings()).filter(F.col("rule").isin("rich", "many-orders", "wikilink-unresolved", "claims-transition"))


@_query(f"""WITH {_FOUND}, t_ AS (SELECT k, k % 9 = 1 AS new, k % 7 = 2 AND seg <> 'BUILDING' AS tagged, k % 5 = 3 AND facts AS cut FROM c_),
s_ AS (SELECT path, rule, severity, kind, kind = 'name' AS caused, new, tagged, cut FROM r_ JOIN t_ USING (k) WHERE new OR tagged OR cut OR kind = 'name'
  UNION ALL SELECT path, 'claims-transition', 'error', 'page', false, new, tagged, cut FROM c_ JOIN t_ USING (k) WHERE known AND cut AND NOT new),
d_ AS (SELECT *, severity = 'error' AND NOT new AND NOT caused AND (kind = 'line' OR (kind = 'tag' AND NOT tagged) OR (kind = 'section' AND NOT cut)) AS demoted FROM s_)
SELECT path, rule, CASE WHEN demoted THEN 'warning' ELSE severity END AS severity, CASE WHEN demoted THEN 'error' END AS demoted_from, count(*) AS n FROM d_ GROUP BY ALL
UNION ALL SELECT '', 'instances-max', 'error', NULL, 1 UNION ALL SELECT 'wiki/nation/NATION_3.md', 'renamed-without-alias', 'error', NULL, 1""")
def q66_bundle_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change answers for: new and edited customers, sections and lines that they inherit, names that a deletion and a rename change elsewhere."""
    found = _bundle(spark, sf_dir, True).scoped().filter("rule <> 'unevaluated'")
    return found.groupBy("path", "rule", "severity", "demoted_from").agg(F.count("*").alias("n"))


@_query(f"""WITH {_FOUND}, l_ AS (SELECT path, c_nationkey AS n FROM c_ JOIN customer ON c_custkey = k WHERE NOT lost)
SELECT path AS "from", 'tag:' || lower(seg) AS "to", 'tagged' AS kind, NULL AS label FROM c_ WHERE seg <> 'FURNITURE' UNION ALL SELECT path, 'wiki/nation/NATION_' || n || '.md', 'wikilink', NULL FROM l_
UNION ALL SELECT path, 'wiki/nation/NATION_' || n || '.md', 'relation', 'in' FROM l_ WHERE path IN (SELECT path FROM c_ WHERE known)""")
def q67_bundle_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a bundle: registered tags, links, relations of pages whose type declares them."""
    return _bundle(spark, sf_dir, False).graph()


@_query(f"""WITH {_FOUND} SELECT 'tags' AS vocabulary, lower(seg) AS value, count(*) AS uses FROM c_ WHERE known GROUP BY ALL UNION ALL SELECT 'states', s, count(*) FROM o_ WHERE NOT odd GROUP BY ALL""")
def q68_bundle_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of each entry of the vocabularies in a bundle."""
    return _bundle(spark, sf_dir, False).census()


@_query(f"""WITH {_FOUND}, u_ AS (SELECT count(*) FILTER (NOT odd) AS read, count(*) FILTER (odd) AS unread FROM o_)
SELECT count(*) FILTER (facts) + count(*) AS governed, 0::BIGINT AS prose, count(*) FILTER (k % 17 = 6) AS unbound, any_value(read) + count(*) AS parsed_records, any_value(unread) AS malformed_items, 0::BIGINT AS unbound_preambles FROM c_, u_ WHERE known""")
def q69_bundle_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: sections of a bundle by mode, records read and items that can't be read."""
    return _bundle(spark, sf_dir, False).scope()


@_query(f"""WITH {_FOUND} SELECT path, o_orderkey::BIGINT AS order_id FROM orders JOIN c_ ON o_custkey = k WHERE known AND facts AND o_totalprice <= 450000 AND o_orderstatus = 'P'""")
def q70_bundle_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of a retired category, by page and the order that each is about."""
    rows = _bundle(spark, sf_dir, False).records().filter("claim.category = 'p'")
    return rows.select("path", F.regexp_extract("claim.core", "order ([0-9]+)", 1).cast("long").alias("order_id"))


#: Edges between pages with the SQL of q67, and their neighbours from both ends; pages with their heads.
_NEAR = """l_ AS (SELECT path, c_nationkey AS n, known FROM c_ JOIN customer ON c_custkey = k WHERE NOT lost),
e_ AS MATERIALIZED (SELECT path AS f, 'wiki/nation/NATION_' || n || '.md' AS t, 'wikilink' AS kind, '' AS label FROM l_ UNION ALL SELECT path, 'wiki/nation/NATION_' || n || '.md', 'relation', 'in' FROM l_ WHERE known),
n_ AS MATERIALIZED (SELECT f AS path, 'outbound' AS side, kind, label, t AS other FROM e_ UNION ALL SELECT t, 'inbound', kind, label, f FROM e_),
g_ AS (SELECT DISTINCT path, side, kind, label FROM n_),
p_ AS (SELECT path, CASE WHEN known THEN 'customer' ELSE 'client' END AS type, known, '[' || chr(10) || '        "' || lower(seg) || '"' || chr(10) || '      ]' AS tags FROM c_
  UNION ALL SELECT 'wiki/nation/' || n_name || '.md', 'nation', true, '[]' FROM nation)"""


@_query(f"""WITH {_FOUND}, {_NEAR}
SELECT path, '    {{' || chr(10) || '      "path": "' || path || '",' || chr(10) || '      "type": "' || type || '",' || chr(10) || '      "role": ' || CASE WHEN known THEN '"concept"' ELSE 'null' END || ',' || chr(10) || '      "ancestry": [],' || chr(10)
  || '      "title": null,' || chr(10) || '      "description": null,' || chr(10) || '      "tags": ' || tags || ',' || chr(10) || '      "status": "active"' AS line FROM p_
UNION ALL SELECT path, '    }}' FROM p_
UNION ALL SELECT path, '      "' || side || '": {{' FROM (SELECT DISTINCT path, side FROM g_) UNION ALL SELECT path, '      }}' FROM (SELECT DISTINCT path, side FROM g_)
UNION ALL SELECT path, '        "relation": {{' FROM g_ WHERE kind = 'relation' UNION ALL SELECT path, '        }}' FROM g_ WHERE kind = 'relation'
UNION ALL SELECT path, CASE WHEN kind = 'relation' THEN '          "in": [' ELSE '        "wikilink": [' END FROM g_ UNION ALL SELECT path, CASE WHEN kind = 'relation' THEN '          ]' ELSE '        ]' END FROM g_
UNION ALL SELECT path, CASE WHEN kind = 'relation' THEN '            "' ELSE '          "' END || other || '"' FROM n_""")
def q71_manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a bundle's manifest by page, as they stand before they are sorted; nations are linked from a share of all customers each."""
    return artifacts.manifest_lines(_bundle(spark, sf_dir, False)).select("path", "line")


@_query(f"""WITH {_FOUND}, {_NEAR}, a_ AS (SELECT f, t, kind, label FROM e_ UNION ALL SELECT path, 'tag:' || lower(seg), 'tagged', '' FROM c_ WHERE seg <> 'FURNITURE')
SELECT f AS place, '    {{' || chr(10) || '      "from": "' || f || '",' || chr(10) || '      "to": "' || t || '",' || chr(10) || '      "kind": "' || kind || '"' || CASE WHEN label = '' THEN '' ELSE ',' || chr(10) || '      "label": "' || label || '"' END || chr(10) || '    }}' AS line FROM a_
UNION ALL SELECT path, '    {{' || chr(10) || '      "id": "' || path || '",' || chr(10) || '      "kind": "page",' || chr(10) || '      "type": "' || type || '",' || chr(10) || '      "title": null' || chr(10) || '    }}' FROM p_
UNION ALL SELECT 'tag:' || t, '    {{' || chr(10) || '      "id": "tag:' || t || '",' || chr(10) || '      "kind": "tag"' || chr(10) || '    }}' FROM unnest(['building', 'household', 'machinery', 'automobile']) AS u(t)""")
def q72_graph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes and edges of a bundle's graph as the file holds them."""
    nodes, edges = artifacts.graph_lines(_bundle(spark, sf_dir, False))
    return nodes.select(F.col("id").alias("place"), "line").union(edges.select("from", "line"))

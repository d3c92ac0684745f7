"""The registered queries of the engine and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import evidence, folders, names, search, transitions, verdict, writer
from scriptorium.plans import projections as P
from scriptorium.sources import git, states

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# ------------------------------------------------------------------ SQL that the oracles share

_SEP = r"[\x{09}-\x{0d}\x{20}-\x{2f}\x{3a}-\x{40}\x{5b}-\x{60}\x{7b}-\x{7e}\x{85}\x{a0}\x{ad}\x{b7}\x{2000}-\x{206f}\x{3000}-\x{303f}]+"


def _ident(x: str) -> str:
    return f"replace(lower(nfc_normalize({x})), 'ß', 'ss')"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({_ident(x)}, '{_SEP}'), lambda t: t <> '')"


_PAGES = """pages_ AS (
  SELECT 'wiki/' || source || '/Doc ' || d.doc_id || '.md' AS path, 'Doc ' || d.doc_id AS base, lang AS type, source, string_split(text, chr(10))[1] AS title,
         CASE WHEN quality = 0 THEN 'retired' ELSE 'active' END AS status, text AS body
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_INDEX = f"""{_PAGES}, words_ AS (
  SELECT path, {_tokens("body")} AS own, {_tokens("base || chr(10) || source || chr(10) || type || chr(10) || title")} AS names FROM pages_),
len_ AS (SELECT path, len(own) + 3 * len(names) AS length FROM words_),
postings_ AS (SELECT path, term, sum(w)::BIGINT AS tf FROM (
  SELECT path, unnest(own) AS term, 1 AS w FROM words_ UNION ALL SELECT path, unnest(names), 3 FROM words_) GROUP BY ALL)"""
_BM25 = """stats_ AS (SELECT count(*) AS n, avg(length) AS al FROM len_),
df_ AS (SELECT term, count(*) AS df FROM postings_ GROUP BY term),
parts_ AS (SELECT q.query_id, p.path, p.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al)) AS part
  FROM asked_ q JOIN postings_ p USING (term) JOIN df_ USING (term) JOIN len_ USING (path), stats_),
scores_ AS (SELECT query_id, path, round(list_reduce(list_prepend(0.0::DOUBLE, list(part::DOUBLE ORDER BY term)), lambda a, b: a + b), 6) AS score FROM parts_ GROUP BY ALL)"""
_ENTITIES = """entities_ AS (
  SELECT 'wiki/region/' || r_regionkey || '.md' AS path, 'region' AS type, 'region ' || r_regionkey AS alias, r_name AS title FROM region
  UNION ALL SELECT 'wiki/nation/' || n_nationkey || '.md', 'nation', 'nation ' || n_nationkey, n_name FROM nation
  UNION ALL SELECT 'wiki/customer/' || c_custkey || '.md', 'customer', 'customer ' || c_custkey, c_name FROM customer
  UNION ALL SELECT 'wiki/supplier/' || s_suppkey || '.md', 'supplier', 'supplier ' || s_suppkey, s_name FROM supplier
  UNION ALL SELECT 'wiki/part/' || p_partkey || '.md', 'part', 'part ' || p_partkey, p_name FROM part
  UNION ALL SELECT 'wiki/order/' || o_orderkey || '.md', 'order', 'order ' || o_orderkey, o_orderkey::VARCHAR FROM orders)"""
_CHAINS = "chains_ AS (SELECT unnest(['region','nation','customer','supplier','part','order']) AS type, unnest([['region','place','entity'],['nation','place','entity'],['customer','party','entity'],['supplier','party','entity'],['part','entity'],['order','entity']]) AS chain)"
_RELATIONS = """relations_ AS (
  SELECT 'wiki/nation/' || n_nationkey || '.md' AS page, 'part-of' AS label, 'wiki/region/' || n_regionkey || '.md' AS target FROM nation
  UNION ALL SELECT 'wiki/customer/' || c_custkey || '.md', 'located-in', 'wiki/nation/' || c_nationkey || '.md' FROM customer
  UNION ALL SELECT 'wiki/supplier/' || s_suppkey || '.md', 'located-in', 'wiki/nation/' || s_nationkey || '.md' FROM supplier
  UNION ALL SELECT 'wiki/order/' || o_orderkey || '.md', 'placed-by', 'wiki/customer/' || o_custkey || '.md' FROM orders
  UNION ALL SELECT 'wiki/order/' || l_orderkey || '.md', 'contains', 'wiki/part/' || l_partkey || '.md' FROM lineitem)"""
_CLAIMS = """claims_ AS (SELECT 'wiki/order/' || l_orderkey || '.md' AS path, l_linenumber AS pos, l_returnflag AS category, l_linestatus AS provenance,
  'part ' || l_partkey || ' from ' || l_suppkey || ' quantity ' || l_quantity::INTEGER AS core, l_linestatus = 'F' AS closed FROM lineitem)"""
_TURNS = "turns_ AS (SELECT conv_id, turn, role, (generate_subscripts(p, 1) - 1)::INTEGER AS pos, unnest(p) AS text FROM (SELECT *, string_split(text, '. ') AS p FROM conversations))"

QUESTION = "the ation of"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ names and search


@_query(f"WITH {_PAGES}, o AS (SELECT path, {_ident('trim(title)')} AS ident, min(path) OVER (PARTITION BY {_ident('trim(title)')}) AS owner FROM pages_) SELECT * FROM o WHERE path <> owner")
def q01_title_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose title's identity key another, earlier page has."""
    pages = P.doc_pages(spark, sf_dir).select("path", T.ident(F.trim("title")).alias("ident"))
    owners = pages.groupBy("ident").agg(F.min("path").alias("owner"))
    return pages.join(owners, "ident").filter("path <> owner").select("path", "ident", "owner")


@_query(f"WITH {_INDEX} SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf, (SELECT round(avg(length), 6) FROM len_) AS avg_length FROM postings_ GROUP BY term")
def q02_term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and collection frequency of every term, and the mean length."""
    return search.statistics(P.doc_pages(spark, sf_dir)).withColumn("avg_length", F.round("avg_length", 6))


@_query(f"""WITH {_INDEX}, asked_ AS (SELECT DISTINCT item_id AS query_id, unnest({_tokens("text")}) AS term FROM benchmark), {_BM25}
SELECT query_id, path, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path))::INTEGER AS rank FROM scores_) WHERE rank <= 10""")
def q03_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best pages of each benchmark item."""
    asked = P.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.best(P.doc_pages(spark, sf_dir), asked, 10)


_Q = QUESTION
_LADDER = f"""ladder_ AS (SELECT path, status = 'retired' AS retired, i_body, i_title,
    CASE WHEN {_ident("base")} = '{_Q}' THEN 8192 ELSE 0 END + CASE WHEN i_title = '{_Q}' THEN 1024 WHEN contains(i_title, '{_Q}') THEN 512 ELSE 0 END
    + CASE WHEN '{_Q}' IN (source, type) THEN 128 ELSE 0 END + CASE WHEN contains(i_body, '{_Q}') THEN 32 ELSE 0 END AS raw
  FROM (SELECT *, {_ident("title")} AS i_title, {_ident("body")} AS i_body FROM pages_)),
ranked_ AS (SELECT path, CASE WHEN i_title = '{_Q}' THEN 'identity' ELSE 'relevance' END AS band, CASE WHEN retired AND raw > 0 THEN greatest(1, raw // 2) ELSE raw END AS ladder FROM ladder_)"""


@_query(f"""WITH {_INDEX}, asked_ AS (SELECT DISTINCT 0 AS query_id, unnest(string_split('{_Q}', ' ')) AS term), {_BM25}, {_LADDER},
a_ AS (SELECT path, row_number() OVER (ORDER BY ladder DESC, path) AS r1 FROM ranked_ WHERE ladder > 0),
b_ AS (SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS r2 FROM scores_)
SELECT path, band, ladder::INTEGER AS ladder, coalesce(b_.score, 0) AS lexical, round(coalesce(1 / (60 + r1), 0) + coalesce(1 / (60 + r2), 0), 6) AS score,
  (row_number() OVER (ORDER BY CASE WHEN band = 'identity' THEN 0 ELSE 1 END, CASE WHEN band = 'identity' THEN ladder ELSE 0 END DESC, round(coalesce(1 / (60 + r1), 0) + coalesce(1 / (60 + r2), 0), 6) DESC, path))::INTEGER AS rank
FROM ranked_ LEFT JOIN a_ USING (path) LEFT JOIN b_ USING (path) WHERE r1 IS NOT NULL OR r2 IS NOT NULL""")
def q04_fused_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity ladder and BM25 fused by reciprocal rank."""
    return search.search(P.doc_pages(spark, sf_dir), QUESTION).drop("reasons")


_GRAMS = "list_distinct(list_transform(generate_series(1, length({0})), lambda i: substring(' ' || {0} || ' ', i, 3)))"
_NEAR = "The and attion to thanedble the anea"


@_query(f"""WITH {_PAGES}, forms_ AS (SELECT path, f, display, regexp_replace({_ident("display")}, '{_SEP}', '', 'g') AS c, {_ident("display")} AS normal, list_sort(list_distinct({_tokens("display")})) AS w
  FROM (SELECT path, 0 AS f, base AS display FROM pages_ UNION ALL SELECT path, 1, title FROM pages_)),
uniq_ AS (SELECT * FROM forms_ WHERE c <> '' QUALIFY row_number() OVER (PARTITION BY path, normal ORDER BY f) = 1),
q_ AS (SELECT regexp_replace({_ident(f"'{_NEAR}'")}, '{_SEP}', '', 'g') AS qc, list_sort(list_distinct({_tokens(f"'{_NEAR}'")})) AS qw),
sim_ AS (SELECT path, f, display, normal, CASE WHEN c = qc OR w = qw THEN 1.0::DOUBLE ELSE len(list_intersect(g, qg)) / (len(g) + len(qg) - len(list_intersect(g, qg))) END AS s
  FROM (SELECT *, {_GRAMS.format("c")} AS g, {_GRAMS.format("qc")} AS qg FROM uniq_, q_))
SELECT path, display AS name, round(s, 6) AS score FROM (SELECT * FROM sim_ WHERE s >= 0.4 QUALIFY row_number() OVER (PARTITION BY path ORDER BY s DESC, normal) = 1) ORDER BY score DESC, path LIMIT 20""")
def q05_near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty pages with the most similar name."""
    return search.near(P.doc_pages(spark, sf_dir), _NEAR).drop("reasons")


@_query(f"""WITH {_PAGES}, t_ AS (SELECT path, {_tokens("body")} AS w, {_ident("body")} AS i FROM pages_)
SELECT path FROM t_ WHERE (contains(i, 'onthw') OR contains(i, 'erst')) AND NOT list_has_any(w, ['onthw', 'erst'])""")
def q06_inside_longer_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hold a term only inside longer words."""
    return search.contains_terms(P.doc_pages(spark, sf_dir), "onthw erst")


@_query(r"""WITH l_ AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target_name FROM pages),
n_ AS (SELECT lower(url) AS ident, max(url) AS target FROM pages GROUP BY 1)
SELECT page_id, target_name, target, CASE WHEN target IS NULL THEN 'unresolved' ELSE 'resolved' END AS verdict FROM l_ LEFT JOIN n_ ON lower(trim(target_name)) = ident""")
def q07_link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of web pages resolved by the page's address."""
    pages = P.table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("target_name"))
    index = pages.groupBy(T.ident(F.col("url")).alias("ident")).agg(F.max("url").alias("target")).withColumn("via_alias", F.lit(False))
    return names.resolve(links, index).select("page_id", "target_name", "target", "verdict")


@_query(f"""WITH {_ENTITIES}, {_CHAINS}, refs_ AS (
  SELECT 'wiki/order/' || o_orderkey || '.md' AS path, 'order ' || o_custkey AS target_name, 'party' AS required FROM orders UNION ALL
  SELECT 'wiki/customer/' || c_custkey || '.md', 'Nation ' || (c_nationkey + 3), 'place' FROM customer)
SELECT r.path, 'ref' AS field, target_name, e.path AS target, CASE WHEN e.path IS NULL THEN 'unresolved' ELSE 'wrong-type' END AS kind
FROM refs_ r LEFT JOIN entities_ e ON lower(target_name) = e.alias LEFT JOIN chains_ c ON e.type = c.type WHERE e.path IS NULL OR NOT list_contains(chain, required)""")
def q08_reference_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that name no page or a page outside the required type's chain."""
    orders, customers = P.table(spark, sf_dir, "orders"), P.table(spark, sf_dir, "customer")
    path = lambda kind, key: F.concat(F.lit(f"wiki/{kind}/"), F.col(key).cast("string"), F.lit(".md")).alias("path")
    refs = orders.select(path("order", "o_orderkey"), F.lit("ref").alias("field"), F.concat(F.lit("order "), F.col("o_custkey").cast("string")).alias("target_name"), F.lit("party").alias("required"))
    refs = refs.union(customers.select(path("customer", "c_custkey"), F.lit("ref"), F.concat(F.lit("Nation "), (F.col("c_nationkey") + 3).cast("string")), F.lit("place")))
    pages = P.entity_pages(spark, sf_dir)
    return names.reference_findings(refs, names.name_index(pages), P.chains(spark))


@_query("""WITH v_ AS (SELECT unnest(['1-URGENT','2-HIGH','3-MEDIUM']) AS entry, unnest(['active','retired','active']) AS status, unnest([NULL,'1-URGENT',NULL]) AS successor)
SELECT o_orderkey, o_orderpriority AS value, CASE WHEN status = 'retired' THEN 'vocabulary-retired' ELSE 'vocabulary-unknown' END AS code, successor
FROM orders LEFT JOIN v_ ON o_orderpriority = entry WHERE status = 'retired' OR entry IS NULL""")
def q09_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are retired or no entry of a registered vocabulary."""
    vocabulary = spark.createDataFrame([("1-URGENT", "active", None), ("2-HIGH", "retired", "1-URGENT"), ("3-MEDIUM", "active", None)], "entry string, status string, successor string")
    values = P.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("value"))
    return names.vocabulary_findings(values, vocabulary)


@_query("""SELECT 'event' AS vocabulary, event_type AS value, count(*) AS uses FROM events GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def q10_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of every vocabulary value."""
    return names.census(("event", P.table(spark, sf_dir, "events").select(F.col("event_type").alias("value"))), ("priority", P.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("value"))))


@_query(f"""WITH {_ENTITIES}, {_CHAINS}, c_ AS (SELECT unnest(chain) AS t, n FROM (SELECT type, count(*) AS n FROM entities_ GROUP BY 1) JOIN chains_ USING (type)),
s_ AS (SELECT t, sum(n)::BIGINT AS pages FROM c_ GROUP BY 1), b_ AS (SELECT unnest(['place','party','nation','draft']) AS type, unnest([1,5,0,1]) AS least, unnest([10,1000000000,25,9]) AS most)
SELECT type, coalesce(pages, 0)::BIGINT AS pages, CASE WHEN coalesce(pages, 0) < least THEN 'instances-min' ELSE 'instances-max' END AS code FROM b_ LEFT JOIN s_ ON type = t WHERE coalesce(pages, 0) < least OR coalesce(pages, 0) > most""")
def q11_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types with too few or too many pages, subtypes counted."""
    bounds = spark.createDataFrame([("place", 1, 10), ("party", 5, 1_000_000_000), ("nation", 0, 25), ("draft", 1, 9)], "type string, least long, most long")
    return names.instance_findings(P.entity_pages(spark, sf_dir), P.chains(spark), bounds)


@_query(f"""WITH {_RELATIONS}, n_ AS (SELECT page, count(*) AS n FROM relations_ WHERE label = 'contains' GROUP BY 1)
SELECT 'wiki/order/' || o_orderkey || '.md' AS page, coalesce(n, 0)::BIGINT AS n FROM orders LEFT JOIN n_ ON page = 'wiki/order/' || o_orderkey || '.md' WHERE coalesce(n, 0) < 3""")
def q12_required_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with fewer than three contained parts."""
    owners = P.table(spark, sf_dir, "orders").select(F.concat(F.lit("wiki/order/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("page"))
    return transitions.require_findings(P.relations(spark, sf_dir), owners, ["contains"], 3)


# ------------------------------------------------------------------ sections, graph


@_query("""WITH d_ AS (SELECT unnest(['A','N','R']) AS heading, unnest([0,1,2]) AS p, unnest([1,1,0]) AS least, unnest([2,9,1]) AS most),
s_ AS (SELECT l_orderkey AS page, l_linenumber AS line, l_returnflag AS heading FROM lineitem),
w_ AS (SELECT s_.*, p, most, row_number() OVER (PARTITION BY page, heading ORDER BY line) AS n, max(p) OVER (PARTITION BY page ORDER BY line, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM s_ JOIN d_ USING (heading))
SELECT page, heading, line, 'section-count' AS code FROM w_ WHERE n = most + 1 UNION ALL SELECT page, heading, line, 'section-order' FROM w_ WHERE p < hi
UNION ALL SELECT g.page, d_.heading, 0, 'section-count' FROM (SELECT DISTINCT page FROM s_) g, d_ LEFT JOIN (SELECT page, heading, count(*) AS n FROM s_ GROUP BY ALL) c ON c.page = g.page AND c.heading = d_.heading WHERE least > 0 AND coalesce(n, 0) < least""")
def q13_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and count of lines as sections."""
    declared = spark.createDataFrame([("A", 0, 1, 2, True), ("N", 1, 1, 9, True), ("R", 2, 0, 1, True)], "heading string, pos int, least int, most int, ordered boolean")
    sections = P.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("heading"))
    return transitions.section_findings(sections, declared).withColumn("line", F.coalesce("line", F.lit(0)))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = P.relations(spark, sf_dir).select(F.col("page").alias("from"), F.col("target").alias("to"), F.lit("relation").alias("kind"), "label")
    tagged = P.table(spark, sf_dir, "customer").select(F.concat(F.lit("wiki/customer/"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("from"), F.concat(F.lit("tag:"), F.col("c_mktsegment")).alias("to"), F.lit("tagged").alias("kind"), F.lit(None).cast("string").alias("label"))
    return names.edges(rel, tagged)


_GRAPH = f"""{_RELATIONS}, graph_ AS (SELECT DISTINCT page AS "from", target AS "to", 'relation' AS kind, label FROM relations_ WHERE page <> target
  UNION ALL SELECT DISTINCT 'wiki/customer/' || c_custkey || '.md', 'tag:' || c_mktsegment, 'tagged', NULL FROM customer)"""


@_query(f"WITH {_GRAPH} SELECT kind, NULL::VARCHAR AS label, count(*) AS edges FROM graph_ GROUP BY kind UNION ALL SELECT kind, label, count(*) FROM graph_ WHERE kind = 'relation' GROUP BY kind, label")
def q14_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the graph by kind and label."""
    return names.edge_counts(_graph(spark, sf_dir))


@_query(f"""WITH {_GRAPH}, b_ AS (SELECT "from" AS page, 'out' AS direction, kind, label, "to" AS other FROM graph_ UNION ALL SELECT "to", 'in', kind, label, "from" FROM graph_)
SELECT page, direction, kind, label, count(*) AS n, min(other) AS first_neighbour, max(other) AS last_neighbour, sum(('0x' || substr(md5(other), 1, 8))::BIGINT)::BIGINT AS checksum FROM (SELECT DISTINCT * FROM b_) GROUP BY ALL""")
def q15_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every page by direction, kind and label: how many, the first, the last and a checksum; no hub gathers its neighbours."""
    key = F.conv(F.substring(F.md5(F.col("other").cast("binary")), 1, 8), 16, 10).cast("long")
    rows = names.neighbours(_graph(spark, sf_dir))
    return rows.groupBy("page", "direction", "kind", "label").agg(F.count("*").alias("n"), F.min("other").alias("first_neighbour"), F.max("other").alias("last_neighbour"), F.sum(key).alias("checksum"))


# ------------------------------------------------------------------ snapshots


@_query(f"""WITH {_TURNS}, j_ AS (SELECT a.conv_id, a.turn, a.pos, a.text AS before, b.text AS after FROM turns_ a LEFT JOIN turns_ b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.pos = b.pos WHERE EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn = a.turn + 1))
SELECT conv_id, turn, pos, before, after FROM j_ WHERE before IS DISTINCT FROM after QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) = 1""")
def q16_append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line of each turn that the next turn doesn't keep in place."""
    lines = P.turns(spark, sf_dir)
    now = lines.withColumn("turn", F.col("turn") - 1)
    follows = now.select("conv_id", "turn").distinct()
    return transitions.entries_edited(lines.join(follows, ["conv_id", "turn"], "left_semi"), now, ["conv_id", "turn"])


def _claim_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Open claims, and a later state: some dropped, some with another last digit's spelling, some with a typing error."""
    base = P.claims(spark, sf_dir).filter("not closed")
    pick = (F.regexp_extract("path", "([0-9]+)", 1).cast("long") + F.col("pos")) % 10
    swap = lambda a, b: F.replace("core", F.lit(a), F.lit(b))
    fixed = F.when(pick == 2, swap("quantity", "qantity")).when(pick == 3, F.concat("core", F.lit("7"))).when(pick == 4, swap("quantity", "unquantity")).when(pick == 5, F.concat("core", F.lit(" in"))).when(pick == 6, F.concat(swap("from", "form"), F.lit(" now and here"))).otherwise(F.col("core"))
    return base, base.filter(pick != 1).withColumn("core", fixed)


_TRI = "list_distinct(list_transform(generate_series(1, length({0})), lambda i: substring(' ' || {0} || ' ', i, 3)))"


@_query(f"""WITH {_CLAIMS}, base_ AS (SELECT *, (regexp_extract(path, '([0-9]+)', 1)::BIGINT + pos) % 10 AS pick FROM claims_ WHERE NOT closed),
now_ AS (SELECT path, pos, category, provenance, CASE pick WHEN 2 THEN replace(core, 'quantity', 'qantity') WHEN 3 THEN core || '7' WHEN 4 THEN replace(core, 'quantity', 'unquantity') WHEN 5 THEN core || ' in' WHEN 6 THEN replace(core, 'from', 'form') || ' now and here' ELSE core END AS core FROM base_ WHERE pick <> 1),
gone_ AS (SELECT * FROM base_ ANTI JOIN (SELECT path, category, core FROM now_) USING (path, category, core)), fresh_ AS (SELECT * FROM now_ ANTI JOIN (SELECT path, category, core FROM base_) USING (path, category, core)),
pairs_ AS (SELECT g.path, g.pos, list_sort(string_split(g.core, ' ')) AS w, list_sort(string_split(f.core, ' ')) AS v, {_TRI.format("g.core")} AS a, {_TRI.format("f.core")} AS b,
  levenshtein(f.core, g.core) <= 3 AND length(f.core) >= 12 AND length(g.core) >= 12 AS near FROM gone_ g JOIN fresh_ f ON f.path = g.path AND f.category = g.category AND f.provenance = g.provenance
  WHERE regexp_replace(f.core, '[^0-9]', '', 'g') = regexp_replace(g.core, '[^0-9]', '', 'g')),
kept_ AS (SELECT path, pos FROM pairs_ WHERE (near OR len(list_intersect(a, b)) >= 0.9 * (len(a) + len(b) - len(list_intersect(a, b))))
  AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(['un', 'non', 'dis', 'in', 'im', 'ir', 'il', 'anti']) AS p) WHERE len(list_intersect(list_transform(list_filter(w, lambda x: NOT list_contains(v, x)), lambda x: p || x), v)) + len(list_intersect(list_transform(list_filter(v, lambda x: NOT list_contains(w, x)), lambda x: p || x), w)) > 0)
  AND NOT list_has_any(list_concat(list_filter(w, lambda x: NOT list_contains(v, x)), list_filter(v, lambda x: NOT list_contains(w, x))), ['not', 'no', 'never', 'none', 'nor', 'without', 'cannot', 'un', 'non', 'anti']))
SELECT path, pos, category, '#' || substr(sha256(lower(core)), 1, 8) AS handle, core FROM gone_ ANTI JOIN kept_ USING (path, pos)""")
def q17_claims_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that neither stay nor are corrected: by few edits or great likeness, with the same digits and polarity."""
    base, now = _claim_states(spark, sf_dir)
    return transitions.claims_lost(base, now)


@_query(f"""WITH {_CLAIMS}, e_ AS (SELECT path, 'closed ' || core || case when pos % 2 = 0 then '.' else '5' end AS entry FROM claims_)
SELECT DISTINCT c.path, c.pos FROM claims_ c JOIN e_ e ON c.path = e.path WHERE NOT closed AND regexp_matches(entry, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(core) || '($|[^\\p{{L}}\\p{{N}}_])')""")
def q18_landing_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose core an entry of their page quotes as a whole segment."""
    claims = P.claims(spark, sf_dir)
    end = F.when(F.col("pos") % 2 == 0, ".").otherwise("5")
    entries = claims.select("path", F.concat(F.lit("closed "), "core", end).alias("text"))
    return transitions.landed(claims.filter("not closed"), entries)


@_query("""WITH a_ AS (SELECT l_orderkey, l_returnflag AS text, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS k FROM lineitem),
n_ AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'N' ELSE l_returnflag END AS text FROM lineitem), b_ AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, text ORDER BY l_linenumber) AS k FROM n_)
SELECT l_orderkey, l_linenumber, b_.text FROM b_ JOIN a_ USING (l_orderkey, text, k)""")
def q19_inherited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order's later state whose k-th equal stands in the earlier one; large quantities changed their flag between the two."""
    base = P.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("text"), "l_quantity")
    now = base.withColumn("text", F.when(F.col("l_quantity") > 25, "N").otherwise(F.col("text")))
    return transitions.inherited(base, now, ["l_orderkey", "text"], ["l_linenumber"]).select("l_orderkey", "l_linenumber", "text")


@_query("""WITH b_ AS (SELECT 'wiki/order/' || l_orderkey || '.md' AS path, l_linenumber AS pos, l_returnflag AS label, l_shipmode AS target FROM (SELECT *, 'p' || (l_partkey % 5) AS l_shipmode FROM lineitem)),
x_ AS (SELECT path, pos, lower(label) AS label, target, row_number() OVER (PARTITION BY path, lower(label), target ORDER BY pos) AS k FROM b_),
y_ AS (SELECT path, lower(label) AS label, target, row_number() OVER (PARTITION BY path, lower(label), target ORDER BY pos) AS k FROM b_ WHERE pos <> 2)
SELECT path, pos, label, target FROM x_ ANTI JOIN y_ USING (path, label, target, k)""")
def q20_relations_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of the base beyond their k-th equal of the current state."""
    rows = P.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("wiki/order/"), F.col("l_orderkey").cast("string"), F.lit(".md")).alias("path"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("label"), F.concat(F.lit("p"), (F.col("l_partkey") % 5).cast("string")).alias("target"))
    return transitions.relations_removed(rows, rows.filter("pos <> 2")).select("path", "pos", "label", "target")


@_query(f"""WITH {_GRAPH} SELECT DISTINCT "from" AS path, "to" AS via FROM graph_ WHERE kind <> 'tagged' AND "to" IN (SELECT 'wiki/part/' || p_partkey || '.md' FROM part WHERE p_size > 45)""")
def q21_stale_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages one hop before a stale page."""
    stale = P.table(spark, sf_dir, "part").filter("p_size > 45").select(F.concat(F.lit("wiki/part/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"))
    return names.stale_propagation(_graph(spark, sf_dir), stale)


# ------------------------------------------------------------------ findings


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings over order lines: a discount is a warning's place, a return an error's, an own rule for large quantities."""
    line = P.table(spark, sf_dir, "lineitem").withColumn("path", F.concat(F.lit("wiki/order/"), F.col("l_orderkey").cast("string"), F.lit(".md")))
    own = lambda rule, cond, severity: line.filter(cond).select("path", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("l_linenumber").alias("line"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("int").alias("occurrence"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("message"))
    return own("item-unparsed", "l_returnflag = 'R'", "error").union(own("wikilink-unresolved", "l_discount > 0.08", "error")).union(own("large-quantity", "l_quantity > 48", "warning")).union(own("unevaluated", "l_linenumber = 7", "error"))


_FINDINGS = """f_ AS (SELECT 'wiki/order/' || l_orderkey || '.md' AS path, r AS rule, s AS severity, q AS queue, l_linenumber AS line, 'part ' || l_partkey AS message FROM lineitem,
 (VALUES ('item-unparsed', 'error', 'grammar-review'), ('wikilink-unresolved', 'warning', 'link-review'), ('large-quantity', 'warning', 'rule-review'), ('unevaluated', 'info', NULL)) v(r, s, q)
 WHERE CASE r WHEN 'item-unparsed' THEN l_returnflag = 'R' WHEN 'wikilink-unresolved' THEN l_discount > 0.08 WHEN 'large-quantity' THEN l_quantity > 48 ELSE l_linenumber = 7 END)"""


@_query(f"""WITH {_FINDINGS}, w_ AS (SELECT 'wiki/order/' || o_orderkey || '.md' AS path, unnest(['item-unparsed', 'large-quantity', 'unevaluated', 'no-such-rule']) AS waived FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT path, waived, CASE WHEN waived IN ('unevaluated', 'no-such-rule') THEN 'exception-illegal' WHEN EXISTS (SELECT 1 FROM f_ WHERE f_.path = w_.path AND f_.rule = waived) THEN 'exception-applied' ELSE 'exception-stale' END AS rule FROM w_""")
def q22_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waivers that apply, are stale or are illegal."""
    orders = P.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    waivers = orders.select(F.concat(F.lit("wiki/order/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), F.explode(F.array(*map(F.lit, ("item-unparsed", "large-quantity", "unevaluated", "no-such-rule")))).alias("rule"))
    known = verdict.routes(spark).select("rule", "severity").union(spark.createDataFrame([("large-quantity", "warning")], "rule string, severity string"))
    return verdict.exceptions(_findings(spark, sf_dir), waivers, known)[1]


@_query(f"WITH {_FINDINGS} SELECT rule, severity, queue, count(*) AS findings FROM f_ GROUP BY ALL")
def q23_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by rule after routing."""
    routed = verdict.route(_findings(spark, sf_dir), verdict.routes(spark))
    return routed.groupBy("rule", "severity", "queue").agg(F.count("*").alias("findings"))


@_query(f"""WITH {_ENTITIES}, g_ AS (SELECT unnest(['customer','supplier','order']) AS type, unnest(['party-rule','party-rule','order-rule']) AS rule),
u_ AS (SELECT 'wiki/order/' || o_orderkey || '.md' AS path, 'order-rule' AS rule FROM orders WHERE o_orderstatus = 'P'), r_ AS (SELECT unnest(['party-rule','order-rule','idle-rule']) AS rule),
h_ AS (SELECT rule, count(*) AS held FROM entities_ JOIN g_ USING (type) GROUP BY 1), m_ AS (SELECT rule, count(*) AS missed FROM u_ GROUP BY 1)
SELECT rule, (coalesce(held, 0) - coalesce(missed, 0))::BIGINT AS evaluated, ((SELECT count(*) FROM entities_) - coalesce(held, 0))::BIGINT AS not_applicable, coalesce(missed, 0)::BIGINT AS unevaluated FROM r_ LEFT JOIN h_ USING (rule) LEFT JOIN m_ USING (rule)""")
def q24_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on which each rule was evaluated, didn't apply or couldn't be evaluated."""
    pages = P.entity_pages(spark, sf_dir).select("path", "type")
    governed = spark.createDataFrame([("customer", "party-rule"), ("supplier", "party-rule"), ("order", "order-rule")], "type string, rule string")
    rules = spark.createDataFrame([("party-rule",), ("order-rule",), ("idle-rule",)], "rule string")
    unjudged = P.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("wiki/order/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), F.lit("order-rule").alias("rule"))
    return verdict.coverage(pages, rules, governed, unjudged)


@_query(f"WITH {_FINDINGS} SELECT path, rule, severity, line, message FROM f_ ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, path, line, rule, message LIMIT 50")
def q25_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty findings, errors first."""
    routed = verdict.route(_findings(spark, sf_dir), verdict.routes(spark))
    return verdict.cap(routed, 50).select("path", "rule", "severity", "line", "message")


@_query("SELECT conv_id, turn, used::BIGINT AS used FROM (SELECT conv_id, turn, sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 600")
def q26_budgeted_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation that fit a budget of bytes."""
    rows = P.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").alias("size"))
    return verdict.budget(rows, "conv_id", "turn", "size", 600).select("conv_id", "turn", F.col("used").cast("long").alias("used"))


@_query("SELECT sha256(string_agg(line, '' ORDER BY line)) AS digest FROM (SELECT 'wiki/' || source || '/Doc ' || doc_id || '.md' || chr(0) || sha256(text) || chr(10) AS line FROM documents)")
def q27_content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of all pages' contents."""
    return verdict.content_digest(P.doc_pages(spark, sf_dir).select("path", F.col("body").cast("binary").alias("content")))


@_query("""WITH a_ AS (SELECT p_brand, max(p_size) AS m, count(*) AS n FROM part GROUP BY 1), b_ AS (SELECT p_brand || CASE WHEN p_size = 7 THEN ' new' ELSE '' END AS p_brand, max(p_size) AS m, count(*) AS n FROM part GROUP BY 1)
SELECT p_brand, CASE WHEN a_.n IS NULL THEN 'added' WHEN b_.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a_ FULL JOIN b_ USING (p_brand) WHERE a_.n IS NULL OR b_.n IS NULL OR a_.m <> b_.m OR a_.n <> b_.n""")
def q28_law_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations that were added, removed or changed: brands, before and after parts of one size moved to a new one."""
    part = P.table(spark, sf_dir, "part").select("p_brand", "p_size")
    after = part.withColumn("p_brand", F.concat("p_brand", F.when(F.col("p_size") == 7, " new").otherwise("")))
    of = lambda d: d.groupBy("p_brand").agg(F.max("p_size").alias("m"), F.count("*").alias("n"))
    return verdict.diff(of(part), of(after), ["p_brand"], F.struct("m", "n"))


@_query("""SELECT o_orderkey, o_orderstatus IN ('O', 'P') AND (o_totalprice > 1000 OR o_orderpriority LIKE '1-%') AS known,
 list_bool_and(list_transform(lines, lambda l: l <= 45)) AS small FROM orders JOIN (SELECT l_orderkey, list(l_quantity) AS lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def q29_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two expression rules compiled to columns."""
    from scriptorium.functions.cel import compile_rule

    lines = P.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("lines"))
    rows = P.table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    page = {"status": "o_orderstatus", "price": "o_totalprice", "priority": "o_orderpriority", "lines": "lines"}
    known = compile_rule('page.status in ["O", "P"] && (page.price > 1000.0 || page.priority.startsWith("1-"))', {"page": page})
    small = compile_rule("page.lines.all(l, l <= 45.0)", {"page": page})
    return rows.select("o_orderkey", known.alias("known"), small.alias("small"))


@_query("""WITH v_ AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-31') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 3 THEN strftime(ts, '%Y-%m') WHEN 4 THEN 'https://A.Example:8443/x/' || event_id || '?q=1' ELSE strftime(ts, '%Y-%-m-%-d') END AS v FROM events)
SELECT event_id, v, regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_strptime(v, '%Y-%m-%d') IS NOT NULL AS is_date, regexp_full_match(v, '[0-9-]{10}T[0-9:]{8}Z') AS is_date_time,
 CASE WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_strptime(v, '%Y-%m-%d') IS NOT NULL THEN 'day' WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}') THEN 'month' END AS precision,
 CASE WHEN v LIKE 'https:%' THEN 'a.example:8443' END AS host FROM v_""")
def q30_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date, date-time and URI predicates."""
    e, kind = P.table(spark, sf_dir, "events"), F.col("event_id") % 6
    fmt = lambda f: F.date_format("ts", f)
    v = F.when(kind == 0, fmt("yyyy-MM-dd")).when(kind == 1, F.concat(fmt("yyyy-MM"), F.lit("-31"))).when(kind == 2, fmt("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 3, fmt("yyyy-MM")).when(kind == 4, F.concat(F.lit("https://A.Example:8443/x/"), F.col("event_id").cast("string"), F.lit("?q=1"))).otherwise(fmt("yyyy-M-d"))
    rows = e.select("event_id", v.alias("v"))
    return rows.select("event_id", "v", T.is_date(F.col("v")).alias("is_date"), T.is_date_time(F.col("v")).alias("is_date_time"), T.precision(F.col("v")).alias("precision"), T.parse_uri(F.col("v"))["host"].alias("host"))


@_query(f"""WITH t_ AS (SELECT conv_id, turn, role, text, {_tokens("text")} AS w, {_ident("text")} AS i FROM conversations),
s_ AS (SELECT count(*) AS n, avg(len(w)) AS al, count_if(list_contains(w, 'the')) AS d1, count_if(list_contains(w, 'of')) AS d2 FROM t_),
u_ AS (SELECT *, len(list_filter(w, lambda x: x = 'the')) AS f1, len(list_filter(w, lambda x: x = 'of')) AS f2 FROM t_, s_),
p_ AS (SELECT *, CASE WHEN f2 > 0 THEN ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * len(w) / al)) ELSE 0 END + CASE WHEN f1 > 0 THEN ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len(w) / al)) ELSE 0 END AS s FROM u_)
SELECT conv_id::VARCHAR AS path, turn AS line, 'core' AS matched_in, CASE WHEN f1 + f2 = 0 THEN 0 ELSE round(CASE WHEN role = 'system' THEN s / 2 ELSE s END, 6) END AS score, CASE WHEN f1 + f2 = 0 THEN 'text:contains' ELSE 'bm25' END AS tier FROM p_ WHERE f1 + f2 > 0 OR contains(i, 'the') OR contains(i, 'of')""")
def q31_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as items, ranked."""
    rows = P.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line"), F.col("text").alias("core"), F.lit(None).cast("string").alias("rationale"), (F.col("role") == "system").alias("retired"))
    return search.items(rows, "the of")


@_query("""WITH c_ AS (SELECT user_id AS page, event_id AS pos, CASE WHEN event_type = 'purchase' THEN 'file' || (event_id % 7) END AS file, (event_id % 50)::INTEGER AS line FROM events)
SELECT page, pos, line, last_value(file IGNORE NULLS) OVER (PARTITION BY page ORDER BY pos ROWS UNBOUNDED PRECEDING) AS file FROM c_""")
def q32_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare line citations with the last cited file."""
    e = P.table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("page"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "purchase", F.concat(F.lit("file"), (F.col("event_id") % 7).cast("string"))).alias("file"), (F.col("event_id") % 50).cast("int").alias("line"))
    return evidence.carried(rows, ["page"]).select("page", "pos", "line", "file")


# ------------------------------------------------------------------ evidence, folders, states


@_query("""WITH c_ AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN 'src/part/' || l_partkey || '.txt' WHEN 1 THEN 'src/part/' || l_partkey || '.txt/' WHEN 2 THEN 'src/gone/' || l_partkey WHEN 3 THEN 'src/hidden/a/' || l_partkey ELSE 'src/part/' END AS source FROM lineitem)
SELECT l_orderkey, l_linenumber, source, CASE WHEN source LIKE 'src/hidden/%' THEN 'unmeasured' WHEN source = 'src/part/' THEN 'present' WHEN source IN (SELECT 'src/part/' || p_partkey || '.txt' FROM part) THEN 'present'
 WHEN source IN (SELECT 'src/part/' || p_partkey || '.txt/' FROM part) THEN 'kind' ELSE 'missing' END AS status FROM c_""")
def q33_source_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that order lines cite, against the files and folders of the source roots."""
    key = F.col("l_partkey").cast("string")
    pick = F.col("l_partkey") % 5
    file = F.concat(F.lit("src/part/"), key, F.lit(".txt"))
    source = F.when(pick == 0, file).when(pick == 1, F.concat(file, F.lit("/"))).when(pick == 2, F.concat(F.lit("src/gone/"), key)).when(pick == 3, F.concat(F.lit("src/hidden/a/"), key)).otherwise(F.lit("src/part/"))
    cited = P.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", source.alias("source"))
    listing = P.table(spark, sf_dir, "part").select(F.lit("100644").alias("mode"), F.concat(F.lit("src/part/"), F.col("p_partkey").cast("string"), F.lit(".txt")).alias("path"))
    facts = evidence.listed_sources(listing, ["src"]).union(spark.createDataFrame([("src/hidden", "skipped")], "path string, kind string"))
    return evidence.source_status(cited, facts)


@_query(f"""WITH {_GRAPH}, p_ AS (SELECT 'wiki/order/' || o_orderkey || '.md' AS path, CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN false ELSE o_totalprice > 300000 END AS stale, CASE WHEN o_orderstatus = 'P' THEN 'pin-unknown' WHEN o_orderstatus <> 'F' AND o_totalprice > 300000 THEN 'pin-stale' END AS reason FROM orders
  UNION ALL SELECT 'wiki/part/' || p_partkey || '.md', CASE WHEN p_size < 5 THEN NULL ELSE p_size > 47 END, CASE WHEN p_size < 5 THEN 'citation-unresolved' WHEN p_size > 47 THEN 'pin-stale' END FROM part),
n_ AS (SELECT "from" AS path, bool_or(coalesce(stale, false)) AS there, bool_or(stale IS NULL) AS unsure FROM (SELECT DISTINCT "from", "to" FROM graph_ WHERE kind <> 'tagged') JOIN p_ ON "to" = path GROUP BY 1)
SELECT path, CASE WHEN stale OR coalesce(there, false) THEN true WHEN stale IS NULL OR coalesce(unsure, false) THEN NULL ELSE false END AS stale,
 CASE WHEN stale THEN reason WHEN coalesce(there, false) THEN 'stale-source-cited' WHEN stale IS NULL THEN reason WHEN coalesce(unsure, false) THEN 'source-unverified-cited' END AS reason FROM p_ LEFT JOIN n_ USING (path)""")
def q34_page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness of orders and parts, from their own and that of the pages that they name."""
    size, price, state = F.col("p_size"), F.col("o_totalprice"), F.col("o_orderstatus")
    path = lambda kind, key: F.concat(F.lit(f"wiki/{kind}/"), F.col(key).cast("string"), F.lit(".md")).alias("path")
    orders = P.table(spark, sf_dir, "orders").select(path("order", "o_orderkey"), F.when(state == "P", F.lit(None)).when(state == "F", False).otherwise(price > 300000).alias("stale"), F.when(state == "P", "pin-unknown").when((state != "F") & (price > 300000), "pin-stale").alias("reason"))
    own = orders.union(P.table(spark, sf_dir, "part").select(path("part", "p_partkey"), F.when(size >= 5, size > 47), F.when(size < 5, "citation-unresolved").when(size > 47, "pin-stale")))
    return evidence.page_status(own.select("path"), own, _graph(spark, sf_dir))


@_query("""SELECT state, count(o_orderkey) AS pins FROM (SELECT unnest(['current', 'unchanged', 'stale', 'unknown', 'unmeasured']) AS state) LEFT JOIN (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'current' WHEN 'O' THEN 'stale' ELSE 'unmeasured' END AS state FROM orders) USING (state) GROUP BY 1""")
def q35_pin_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins by state, states without one included."""
    s = F.col("o_orderstatus")
    return evidence.state_counts(P.table(spark, sf_dir, "orders").select(F.when(s == "F", "current").when(s == "O", "stale").otherwise("unmeasured").alias("state")))


@_query("""SELECT path, missing FROM (SELECT 'generated/' || doc_id || '.md' AS path, text, CASE WHEN lang = 'de' THEN text || '!' WHEN n_chars > 3000 THEN NULL ELSE text END AS held, lang <> 'de' AND n_chars > 3000 AS missing FROM documents) WHERE text IS DISTINCT FROM held""")
def q36_generated_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated files that are missing or differ from a fresh render."""
    docs = P.table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("generated/"), F.col("doc_id").cast("string"), F.lit(".md")))
    held = docs.filter("lang = 'de' or n_chars <= 3000").select("path", F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return verdict.drift(docs.select("path", F.col("text").alias("content")), held)


_CUSTOMERS = """k_ AS (SELECT 'wiki/' || c_mktsegment || '/n_' || c_nationkey || '/' || c_custkey || '.md' AS path, replace(lower(c_mktsegment), ' ', '-') AS a, 'n-' || c_nationkey AS b, c_mktsegment AS s, c_custkey FROM customer)"""


@_query(f"""WITH {_CUSTOMERS} SELECT path, 'folder-segment-registered' AS rule, s AS segment FROM k_ WHERE a NOT IN ('automobile', 'building', 'household') UNION ALL
SELECT path, 'folder-segment-registered', 'n_' || substr(b, 3) FROM k_ WHERE b <> 'n-7' UNION ALL SELECT path, 'folder-tags-present', CASE WHEN c_custkey % 2 = 0 THEN '' WHEN a IN ('automobile', 'building', 'household') THEN a || ',' ELSE s || ',' END || CASE WHEN b = 'n-7' THEN 'N 7' ELSE 'n_' || substr(b, 3) END FROM k_""")
def q37_folder_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that are no registered tag, and folder tags that pages lack: customers below segment and nation, every second tagged with its segment."""
    c = P.table(spark, sf_dir, "customer")
    path = F.concat(F.lit("wiki/"), "c_mktsegment", F.lit("/n_"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_custkey").cast("string"), F.lit(".md"))
    pages = c.select(path.alias("path"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.upper("c_mktsegment"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    entries = spark.createDataFrame([("automobile",), ("building",), ("household",), ("N 7",)], "entry string")
    rows = folders.folder_rows(pages, ["wiki"], {})
    a = folders.unregistered(rows, entries).select("path", F.lit("folder-segment-registered").alias("rule"), "segment")
    return a.union(folders.missing(rows, folders.tag_keys(pages), entries).select("path", F.lit("folder-tags-present"), F.array_join("missing", ",")))


@_query("""WITH r_ AS (SELECT 'wiki/order/' || l_orderkey || '.md' AS path, l_linenumber AS pos, l_returnflag AS label, 'Part ' || l_partkey AS target FROM lineitem)
SELECT path, pos, lower(label) AS label, lower(target) AS target FROM r_ x WHERE pos > 2 AND NOT EXISTS (SELECT 1 FROM r_ y WHERE y.path = x.path AND y.pos % 3 = 0 AND y.label = x.label AND y.target = x.target)""")
def q38_relations_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that left their page and that no new entry quotes: all but the first two leave, every third is quoted."""
    line = P.table(spark, sf_dir, "lineitem")
    rows = line.select(F.concat(F.lit("wiki/order/"), F.col("l_orderkey").cast("string"), F.lit(".md")).alias("path"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("label"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("target"))
    entries = rows.filter("pos % 3 = 0").select("path", F.concat(F.lit("no longer "), "label", F.lit(" [["), F.upper("target"), F.lit("#facts|it]].")).alias("text"))
    left = transitions.multiset_except(rows, rows.filter("pos <= 2"), ["path", "pos"], ["pos"])
    return transitions.relations_removed(left, rows.limit(0), entries).select("path", "pos", "label", "target")


@_query(f"""WITH {_FINDINGS}, now_ AS MATERIALIZED (SELECT * FROM f_ WHERE rule <> 'unevaluated'), t_ AS MATERIALIZED (SELECT 'wiki/order/' || o_orderkey || '.md' AS path FROM orders WHERE o_orderstatus = 'P'),
old_ AS MATERIALIZED (SELECT DISTINCT path, rule, line FROM f_ WHERE line <> 2)
SELECT path, rule, severity, line FROM now_ SEMI JOIN t_ USING (path) UNION ALL SELECT path, rule, severity, line FROM (SELECT * FROM now_ ANTI JOIN t_ USING (path)) ANTI JOIN old_ USING (path, rule, line)""")
def q39_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a write answers for: those on pages that it touches, and those that the disk's own verdict lacks."""
    found = verdict.route(_findings(spark, sf_dir), verdict.routes(spark)).withColumn("details", F.lit(None).cast("map<string,string>"))
    touched = P.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("wiki/order/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"))
    return verdict.regressions(found.filter("rule <> 'unevaluated'"), found.filter("line <> 2"), touched).select("path", "rule", "severity", "line")


@_query(f"""WITH {_FINDINGS}, w_ AS (SELECT 'wiki/order/' || o_orderkey || '.md' AS path FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT path, CASE WHEN rule = 'item-unparsed' AND path IN (SELECT path FROM w_) THEN 'exception-applied' ELSE rule END AS rule, CASE WHEN rule = 'item-unparsed' AND path IN (SELECT path FROM w_) THEN 'info' ELSE severity END AS severity, line FROM f_
UNION ALL SELECT path, 'exception-stale', 'warning', 0 FROM w_ WHERE path NOT IN (SELECT path FROM f_ WHERE rule = 'item-unparsed') UNION ALL SELECT path, 'exception-illegal', 'error', 0 FROM w_""")
def q40_applied_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with the waived ones applied, and the waivers that are stale or illegal."""
    found = verdict.route(_findings(spark, sf_dir), verdict.routes(spark)).withColumn("details", F.lit(None).cast("map<string,string>")).select("path", "rule", "severity", "line", "heading", "occurrence", "message", "details")
    orders = P.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("wiki/order/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"))
    waivers = orders.select("path", F.posexplode(F.array(F.lit("item-unparsed"), F.lit("identity-collision"))).alias("index", "rule"), F.lit("why").alias("reason")).select("path", "rule", "reason", "index")
    known = verdict.routes(spark).select("rule", "severity").union(spark.createDataFrame([("large-quantity", "warning")], "rule string, severity string"))
    return verdict.apply_exceptions(found, waivers, known, orders.limit(0).withColumn("rule", F.lit(""))).select("path", "rule", "severity", F.coalesce("line", F.lit(0)).alias("line"))


@_query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'drive' WHEN 1 THEN 'unc' WHEN 2 THEN 'absolute' WHEN 3 THEN 'backslash' WHEN 4 THEN 'trailing-slash' WHEN 5 THEN 'empty-segment' WHEN 6 THEN 'dot-segment' WHEN 7 THEN 'traversal' END AS refusal FROM events""")
def q41_path_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason for which a path is refused."""
    n = F.col("event_id") % 9
    forms = ["C:/wiki/x\\y.md", "//wiki/x.md", "/wiki/../x.md", "wiki\\x/./y.md", "wiki/../x/", "wiki//../x.md", "wiki/./../x.md", "wiki/../x.md", "wiki/x.md"]
    return P.table(spark, sf_dir, "events").select("event_id", T.path_refusal(F.get(F.array(*map(F.lit, forms)), n)).alias("refusal"))


@_query("""SELECT * FROM (SELECT 'wiki/' || o_orderkey || '.md' AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'draft' ELSE o_orderstatus END AS content, o_orderstatus AS base_content FROM orders UNION ALL SELECT 'wiki/new.md', 'draft', NULL)""")
def q42_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts laid over the disk: content and base of every page."""
    disk = P.table(spark, sf_dir, "orders").select(F.concat(F.lit("wiki/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), F.col("o_orderstatus").cast("binary").alias("content"), "o_orderkey")
    drafts = disk.filter("o_orderkey % 5 = 0").select("path", F.lit("draft").cast("binary").alias("content")).union(spark.createDataFrame([("wiki/new.md", bytearray(b"draft"))], "path string, content binary"))
    return states.overlay(disk.drop("o_orderkey"), drafts).select("path", F.decode("content", "UTF-8").alias("content"), F.decode("base_content", "UTF-8").alias("base_content"))


@_query("""SELECT doc_id, sha256('{"lang":"' || lang || '","n":' || n_chars || ',"source":"' || source || '"}' || chr(0) || text) AS digest FROM documents""")
def q43_page_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each page's canonical frontmatter without its meta keys, and its body."""
    front = F.to_json(F.struct("source", F.col("n_chars").alias("n"), "lang", F.col("doc_id").alias("updated")))
    return P.table(spark, sf_dir, "documents").select("doc_id", T.page_digest(front, F.array(F.lit("updated")), F.col("text")).alias("digest"))


@_query("""SELECT 'wiki/' || o_orderkey AS path, CASE o_orderkey % 7 WHEN 6 THEN 'not-named' ELSE 'not-differing' END AS side FROM orders WHERE o_orderkey % 7 IN (3, 6)""")
def q44_listing_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths on which two listings and the diff between them tell different stories: those of remainder 2 differ, of 6 are new; the diff names 2 and 3."""
    index = P.table(spark, sf_dir, "orders").select(F.concat(F.lit("wiki/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_custkey").cast("long").alias("oid"), F.lit("m").alias("mode"), (F.col("o_orderkey") % 7).alias("r"))
    base = index.filter("r <> 6").withColumn("oid", F.when(F.col("r") == 2, F.col("oid") + 1).otherwise(F.col("oid")))
    return git.disagreements(index, base, index.filter("r in (2, 3)").select("path"))


# ------------------------------------------------------------------ places, names, texts, totals


@_query("""SELECT CASE doc_id % 4 WHEN 0 THEN 'wiki/' || source || '/Sub_' || lang || '/' || doc_id || '.md' WHEN 1 THEN 'raw/' || source || '/' || doc_id || '.md' WHEN 2 THEN 'wiki/' || doc_id || '.txt' ELSE 'wiki/../' || doc_id || '.md' END AS path,
doc_id % 4 = 0 AS content, CASE doc_id % 4 WHEN 0 THEN source || ',Sub_' || lang END AS folders, CASE doc_id % 4 WHEN 0 THEN 'sub-' || lang END AS key FROM documents""")
def q45_folder_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths are pages of the content root, their folders, and the identity of the second."""
    key, pick = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    path = (
        F.when(pick == 0, F.concat(F.lit("wiki/"), "source", F.lit("/Sub_"), "lang", F.lit("/"), key, F.lit(".md"))).when(pick == 1, F.concat(F.lit("raw/"), "source", F.lit("/"), key, F.lit(".md")))
        .when(pick == 2, F.concat(F.lit("wiki/"), key, F.lit(".txt"))).otherwise(F.concat(F.lit("wiki/../"), key, F.lit(".md")))
    )
    rows = P.table(spark, sf_dir, "documents").select(path.alias("path")).withColumn("content", T.is_content_path(F.col("path"), ["wiki"]))
    held = rows.withColumn("f", F.when(F.col("content"), T.folder_segments(F.col("path"), "wiki")))
    return held.select("path", "content", F.array_join("f", ",").alias("folders"), T.segment_identity(F.get("f", F.lit(1))).alias("key"))


@_query(f"""WITH {_FINDINGS} SELECT scope, count_if(severity = 'error') AS errors, count_if(severity = 'warning') AS warnings, count_if(severity = 'info') AS infos
FROM f_, (VALUES ('all', '', ''), ('rule', 'large-quantity', ''), ('folder', '', 'wiki/order/'), ('page', '', 'wiki/order/7.md')) v(scope, r, p) WHERE (r = '' OR rule = r) AND starts_with(path, p) GROUP BY scope""")
def q46_severity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by severity: all, those of a rule, below a folder, of a page."""
    found = verdict.route(_findings(spark, sf_dir), verdict.routes(spark))
    out = None
    for scope, rule, path in (("all", None, None), ("rule", "large-quantity", None), ("folder", None, "wiki/order"), ("page", None, "wiki/order/7.md")):
        own = verdict.totals(verdict.filtered(found, rule, path)).select(F.lit(scope).alias("scope"), "errors", "warnings", "infos").filter("errors + warnings + infos > 0")
        out = own if out is None else out.union(own)
    return out


@_query("""SELECT event_type AS rule, string_agg(DISTINCT 'reason ' || (user_id % 3), ',' ORDER BY 'reason ' || (user_id % 3)) AS reasons FROM events GROUP BY 1""")
def q47_unevaluated_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why rules were not evaluated, each reason once."""
    rows = P.table(spark, sf_dir, "events").select(F.col("event_type").alias("rule"), F.concat(F.lit("reason "), (F.col("user_id") % 3).cast("string")).alias("reason"))
    return verdict.unevaluated_reasons(rows).select("rule", F.array_join("reasons", ",").alias("reasons"))


@_query("""WITH h_ AS (SELECT conv_id, turn, 'Topic ' || (turn % 4) AS heading, row_number() OVER (PARTITION BY conv_id, turn % 4 ORDER BY turn) - 1 AS occurrence FROM conversations WHERE role = 'user')
SELECT p.conv_id::VARCHAR AS path, p.turn AS line, h.heading, h.occurrence::INTEGER AS occurrence FROM (FROM conversations WHERE role <> 'user') p ASOF LEFT JOIN h_ h ON p.conv_id = h.conv_id AND p.turn >= h.turn""")
def q48_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading that each answer stands under and its number among equal headings; questions are headings."""
    rows = P.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line"), "role")
    headings = rows.filter("role = 'user'").select("path", "line", F.concat(F.lit("Topic "), (F.col("line") % 4).cast("string")).alias("heading"))
    return names.location_at(rows.filter("role <> 'user'").select("path", "line"), headings)


@_query("""WITH d_ AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS eve FROM orders)
SELECT o_orderkey, 'retracted ' || day AS retracted, 'valid →' || eve || ', superseded ' || day || ' by [[Order ' || o_orderkey || ']]' AS superseded FROM d_""")
def q49_closing_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses that close a claim on a day."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    by = F.concat(F.lit("[[Order "), F.col("o_orderkey").cast("string"), F.lit("]]"))
    return P.table(spark, sf_dir, "orders").select("o_orderkey", T.retract_clause(day).alias("retracted"), T.supersede_clause(day, by).alias("superseded"))


@_query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'fix' WHEN 1 THEN 'feat' WHEN 3 THEN 'docs' WHEN 4 THEN 'law-change' WHEN 5 THEN 'chore' ELSE 'none' END AS prefix,
CASE event_id % 6 WHEN 1 THEN 'because ' || user_id WHEN 5 THEN 'second' END AS reason FROM events""")
def q50_commit_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix of a message and the reason that it gives for a change of the law."""
    user = F.col("user_id").cast("string")
    forms = [
        F.lit("fix: a value"), F.concat(F.lit("feat(core)!: more\n\nlaw-change: because "), user), F.lit("no prefix here"), F.lit("docs:x\n# law-change: commented out"),
        F.lit("law-change: in the subject only"), F.lit("  chore!: y\r\nlaw-change:  \r\nlaw-change: second\r\nlaw-change: third"),
    ]
    message = F.get(F.array(*forms), (F.col("event_id") % 6).cast("int"))
    return P.table(spark, sf_dir, "events").select("event_id", T.commit_prefix(message).alias("prefix"), T.law_change_reason(message).alias("reason"))


@_query("""SELECT doc_id, replace(replace(replace(text, chr(92), chr(92) || chr(92)), '|', chr(92) || '|'), chr(10), ' ') AS cell,
list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#'))[1] AS lede FROM documents""")
def q51_cells_and_ledes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a table cell, and its first line of prose."""
    return P.table(spark, sf_dir, "documents").select("doc_id", T.table_cell(F.col("text")).alias("cell"), T.lede(F.col("text")).alias("lede"))


@_query("""WITH e_ AS (SELECT 'region' AS kind, r_regionkey AS key FROM region UNION ALL SELECT 'nation', n_nationkey FROM nation UNION ALL SELECT 'customer', c_custkey FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'part', p_partkey FROM part UNION ALL SELECT 'order', o_orderkey FROM orders)
SELECT key::VARCHAR AS ident, path, owner FROM (SELECT key, 'wiki/' || kind || '/' || key || '.md' AS path, min('wiki/' || kind || '/' || key || '.md') OVER (PARTITION BY key) AS owner FROM e_) WHERE path <> owner""")
def q52_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose name another page owns: entities of several kinds share their keys as base names."""
    return names.collisions(P.entity_pages(spark, sf_dir)).filter("kind = 0").select("ident", "path", "owner")


@_query("""WITH l_ AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
e_ AS (SELECT doc_id, line, strlen(x) AS n, sum(strlen(x) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS stop FROM l_)
SELECT doc_id, line::INTEGER AS line, (stop - n - 1)::INTEGER AS start, (stop - 1)::INTEGER AS "end" FROM e_""")
def q53_byte_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offsets of every line."""
    return P.table(spark, sf_dir, "documents").select("doc_id", F.inline(T.byte_spans(F.col("text"))))


@_query("""SELECT governed, prose, unbound, parsed_records, malformed_items, unbound_preambles FROM (SELECT count_if(l_returnflag NOT IN ('R', 'N')) AS governed, count_if(l_returnflag = 'R') AS prose, count_if(l_returnflag = 'N') AS unbound,
 sum(l_linenumber)::BIGINT AS parsed_records, count_if(l_quantity > 48) AS malformed_items FROM lineitem), (SELECT count_if(o_orderstatus NOT IN ('P', 'F')) AS unbound_preambles FROM orders)""")
def q54_scope_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by how they are governed, records read, and pages with text before their first heading."""
    flag, state = F.col("l_returnflag"), F.col("o_orderstatus")
    mode = F.when(flag == "R", "prose").when(flag == "N", "unbound").otherwise("record")
    sections = P.table(spark, sf_dir, "lineitem").select(mode.alias("mode"), F.col("l_linenumber").cast("long").alias("records"), (F.col("l_quantity") > 48).cast("long").alias("unread"))
    return verdict.scope_coverage(sections, P.table(spark, sf_dir, "orders").select(F.when(state == "P", "  ").when(state != "F", "text").alias("preamble")))


@_query("""SELECT event_type AS rule, count(*) AS excepted FROM events WHERE user_id % 2 = 0 GROUP BY 1""")
def q55_excepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applied exceptions by the rule that they waive: those of even users apply."""
    rule = F.when(F.col("user_id") % 2 == 0, "exception-applied").otherwise("exception-stale")
    return verdict.excepted(P.table(spark, sf_dir, "events").select(rule.alias("rule"), F.create_map(F.lit("rule"), F.col("event_type")).alias("details")))


@_query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 2 THEN c_name || ' (a)' END AS stem, lower(replace(c_name, '#', '')) || CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 2 THEN 'ab' ELSE '' END AS compact FROM customer""")
def q56_name_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names before their last qualifier, and without separators."""
    pick = F.col("c_custkey") % 3
    name = F.when(pick == 0, F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))).when(pick == 2, F.concat("c_name", F.lit(" (a) (b)"))).otherwise(F.col("c_name"))
    return P.table(spark, sf_dir, "customer").select("c_custkey", T.strip_qualifier(name).alias("stem"), T.compact(name).alias("compact"))


@_query("""SELECT doc_id, text, doc_id % 2 = 0 AS mark, doc_id % 3 = 0 AND contains(text, chr(10)) AS crlf FROM documents""")
def q57_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as they are read: every second has a byte order mark, every third carriage returns."""
    lines = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    raw = F.concat(F.when(F.col("doc_id") % 2 == 0, "\ufeff").otherwise(""), lines)
    return P.table(spark, sf_dir, "documents").select("doc_id", T.normalized(raw).alias("n")).select("doc_id", "n.text", "n.mark", "n.crlf")


# ------------------------------------------------------------------ pins, sections, splices, the gate


@_query("""SELECT 'wiki/customer/' || o_custkey || '.md' AS path, bool_and(o_orderstatus <> 'P') AS evaluated FROM orders GROUP BY 1""")
def q58_pinned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose pins were all measured: orders are the pins of their customer."""
    s = F.col("o_orderstatus")
    pins = P.table(spark, sf_dir, "orders").select(F.concat(F.lit("wiki/customer/"), F.col("o_custkey").cast("string"), F.lit(".md")).alias("path"), F.when(s == "F", "current").when(s == "O", "stale").otherwise("unmeasured").alias("state"))
    return evidence.page_cells(pins)


_SECTIONS = "li_ AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)"


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line, flag, quantity): one section a line number of an order."""
    path = F.concat(F.lit("wiki/order/"), F.col("l_orderkey").cast("string"), F.lit(".md"))
    lines = P.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("int").alias("line")).agg(F.min("l_returnflag").alias("flag"), F.max("l_quantity").alias("quantity"))
    return lines.select(path.alias("path"), "line", "flag", "quantity")


@_query(f"""WITH {_SECTIONS} SELECT 'wiki/order/' || l_orderkey || '.md' AS path, l_linenumber AS line, l_returnflag AS heading, 'max' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS n FROM li_) WHERE n = 2
UNION ALL SELECT 'wiki/order/' || o_orderkey || '.md', NULL, 'A', 'min' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM li_ WHERE l_returnflag = 'A')
UNION ALL SELECT 'wiki/order/' || l_orderkey || '.md', l_linenumber, 'x', 'min' FROM li_ WHERE l_returnflag = 'R' AND l_quantity <= 25""")
def q59_section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that occur too often or too seldom in their parent: an order has one section a flag and needs an A, each R needs an x below it."""
    line = _sections(spark, sf_dir)
    address = F.concat("flag", F.lit("#"), F.col("line").cast("string"))
    top = line.select("path", F.array("flag").alias("section_path"), F.lit("").alias("parent"), "line", F.col("flag").alias("heading"), F.lit(0).alias("occurrence"), F.lit(1).alias("most"))
    inner = line.filter("flag = 'R' and quantity > 25").select("path", F.array("flag", F.lit("x")), address, "line", F.lit("x"), F.lit(0), F.lit(1))
    declared = F.array(*(F.struct(F.array(*map(F.lit, p)).alias("path"), F.lit(p[-1]).alias("heading"), F.lit(1).alias("least")) for p in (["A"], ["R", "x"])))
    pages = P.table(spark, sf_dir, "orders").select(F.concat(F.lit("wiki/order/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), declared.alias("declared"))
    parents = line.select("path", F.array("flag").alias("section_path"), address.alias("address"), "line", F.col("flag").alias("heading"), F.lit(0).alias("occurrence"))
    return transitions.section_counts(top.union(inner), pages, parents).select("path", "line", "heading", "kind")


@_query(f"""WITH {_SECTIONS} SELECT path, line, rank FROM (SELECT *, max(rank) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
FROM (SELECT 'wiki/order/' || l_orderkey || '.md' AS path, l_linenumber AS line, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS rank FROM li_)) WHERE rank < m""")
def q60_section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that come after one that is declared later: flags are declared in the order A, N, R."""
    rank = F.when(F.col("flag") == "A", 1).when(F.col("flag") == "N", 2).otherwise(3)
    return transitions.out_of_order(_sections(spark, sf_dir).select("path", "line", rank.alias("rank")))


@_query("""WITH t_ AS (SELECT p_partkey, '---' || chr(10) || 'type: part' || chr(10) || 'tags: [a]' || chr(10) || '---' || chr(10) || '# ' || p_name || chr(10) || chr(10) || '## Notes' || chr(10) || chr(10) || '- first' || chr(10) AS text FROM part)
SELECT 'wiki/part/' || p_partkey || '.md' AS path, CASE p_partkey % 4 WHEN 0 THEN replace(text, '[a]', '[a, b]') WHEN 1 THEN text || '- second' || chr(10) WHEN 2 THEN replace(text, 'type: part' || chr(10), '') ELSE text END AS text,
CASE p_partkey % 4 WHEN 3 THEN '0 sections Gone' END AS refused FROM t_""")
def q61_splices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages after an operation each: a tag more, an item more, a field less, or an unknown section."""
    part, pick = P.table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    path = F.concat(F.lit("wiki/part/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path")
    pages = part.select(path, F.concat(F.lit("---\ntype: part\ntags: [a]\n---\n# "), "p_name", F.lit("\n\n## Notes\n\n- first\n")).alias("text"))
    of = lambda *v: F.when(pick == 0, v[0]).when(pick == 1, v[1]).when(pick == 2, v[2]).otherwise(v[3])
    ops = part.select(path, F.lit(0).alias("seq"), of("append", "under", "remove", "under").alias("op"), of("tags", "Notes", "type", "Gone").alias("key"), of("b", "- second", "", "- lost").alias("value"))
    return writer.apply(pages, ops)


@_query(f"""WITH {_FINDINGS}, {_SECTIONS}, now_ AS (SELECT l_orderkey, l_linenumber AS line, l_returnflag AS heading, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS k, l_quantity AS raw FROM li_),
base_ AS (SELECT l_orderkey, l_returnflag AS heading, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS k, l_quantity + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS raw FROM li_ WHERE l_linenumber > 1),
u_ AS (SELECT 'wiki/order/' || n.l_orderkey || '.md' AS path, line, n.heading, n.raw = b.raw AS same FROM now_ n LEFT JOIN base_ b ON n.l_orderkey = b.l_orderkey AND n.heading = b.heading AND n.k = b.k),
s_ AS (SELECT f_.*, severity = 'error' AND coalesce(same, false) AS demoted FROM f_ LEFT JOIN u_ USING (path, line) WHERE rule = 'large-quantity' OR path IN (SELECT 'wiki/order/' || o_orderkey || '.md' FROM orders WHERE o_orderstatus <> 'F'))
SELECT path, rule, line, CASE WHEN demoted THEN 'warning' ELSE severity END AS severity, CASE WHEN demoted THEN 'error' END AS demoted_from FROM s_""")
def q62_gate_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a commit answers for: open orders are touched, large quantities concern the whole corpus; an error stands on its section's heading and is inherited with the section's text, although its line number is.

    The base lacks each order's first section, so later ones of its flag have other numbers there, and has other quantities in every third.
    """
    path = lambda c: F.concat(F.lit("wiki/order/"), F.col(c).cast("string"), F.lit(".md")).alias("path")
    number = F.row_number().over(Window.partitionBy("path", "heading").orderBy("line")) - 1
    numbered = lambda d: d.select("path", "line", F.col("flag").alias("heading"), F.col("quantity").cast("string").alias("raw")).withColumn("occurrence", number)
    sections = _sections(spark, sf_dir)
    other = F.col("quantity") + F.when(F.col("line") % 3 == 0, 1).otherwise(0)
    now, base = numbered(sections), numbered(sections.filter("line > 1").withColumn("quantity", other))
    found = verdict.route(_findings(spark, sf_dir), verdict.routes(spark)).drop("heading", "occurrence").join(now.select("path", "line", "heading", "occurrence"), ["path", "line"], "left")
    inherited = P.table(spark, sf_dir, "lineitem").select(path("l_orderkey"), F.col("l_linenumber").alias("line")).distinct()
    touched = P.table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select(path("o_orderkey"))
    return verdict.gate_scope(found, inherited, touched, ["large-quantity"], transitions.unchanged_sections(now, base)).select("path", "rule", "line", "severity", "demoted_from")


@_query(f"""WITH {_ENTITIES}, now_ AS (SELECT CASE WHEN type = 'supplier' AND split_part(path, '/', 3) LIKE '%5.md' THEN replace(path, 'supplier/', 'supplier/new-') ELSE path END AS path, alias, type FROM entities_ WHERE NOT (type = 'customer' AND split_part(path, '/', 3) LIKE '%7.md')),
s_ AS (SELECT 0 AS side, path, alias FROM entities_ UNION ALL SELECT 1, path, CASE WHEN path LIKE '%new-%' AND path LIKE '%15.md' THEN 'gone' ELSE alias END FROM now_),
i_ AS (SELECT side, ident, coalesce(max(path) FILTER (kind = 0), min(path) FILTER (kind = 1)) AS target, bool_or(kind = 0) AS own FROM (SELECT side, path, replace(split_part(path, '/', 3), '.md', '') AS ident, 0 AS kind FROM s_ UNION ALL SELECT side, path, alias, 1 FROM s_) GROUP BY side, ident),
c_ AS MATERIALIZED (SELECT coalesce(a.ident, b.ident) AS ident, CASE WHEN b.ident IS NULL THEN 'added' WHEN a.ident IS NULL THEN 'removed' ELSE 'moved' END AS change FROM (SELECT * FROM i_ WHERE side = 1) a FULL JOIN (SELECT * FROM i_ WHERE side = 0) b ON a.ident = b.ident WHERE (a.target, a.own) IS DISTINCT FROM (b.target, b.own)),
w_ AS (SELECT 'wiki/order/' || o_orderkey || '.md' AS path, 'customer ' || o_custkey AS ident FROM orders UNION SELECT 'wiki/order/' || l_orderkey || '.md', 'supplier ' || l_suppkey FROM lineitem)
SELECT path, list_sort(list(ident || ' ' || change)) AS names FROM w_ JOIN c_ USING (ident) GROUP BY path""")
def q63_changed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that write a name which a commit changes: some customers are deleted, some suppliers move, some of these without keeping their other name."""
    pages = P.entity_pages(spark, sf_dir).select("path", "type", "aliases")
    gone = (F.col("type") == "customer") & F.col("path").endswith("7.md")
    moves = pages.filter((F.col("type") == "supplier") & F.col("path").endswith("5.md")).select(F.col("path").alias("renamed_from"), F.replace("path", F.lit("supplier/"), F.lit("supplier/new-")).alias("path"))
    placed = pages.filter(~gone).join(moves.select(F.col("renamed_from").alias("_from"), F.col("path").alias("_to")), F.col("path") == F.col("_from"), "left").select(F.coalesce("_to", "path").alias("path"), "type", "aliases")
    lost = F.col("path").contains("new-") & F.col("path").endswith("15.md")
    now = names.name_index(placed.withColumn("aliases", F.when(lost, F.array(F.lit("gone"))).otherwise(F.col("aliases"))))
    base = names.name_index(names.base_pages(placed, moves, pages.filter(gone)))
    order = lambda c: F.concat(F.lit("wiki/order/"), F.col(c).cast("string"), F.lit(".md")).alias("path")
    name = lambda kind, c: F.concat(F.lit(f"{kind} "), F.col(c).cast("string")).alias("ident")
    written = P.table(spark, sf_dir, "orders").select(order("o_orderkey"), name("customer", "o_custkey")).union(P.table(spark, sf_dir, "lineitem").select(order("l_orderkey"), name("supplier", "l_suppkey")))
    hit = written.distinct().join(names.name_changes(now, base), "ident")
    return hit.groupBy("path").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "ident", "change"))).alias("names"))

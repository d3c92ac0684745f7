"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import filter_audit, jaccard_join, lattice, licenses, line_quality, link_trust, metric_join, mixing, packing, pii, sharding, token_files, word_runs
from scriptorium.llm.common import documents

SHARDS = [f"shard-{k:02d}" for k in range(32)]

#: The rules of op11: host, start of the path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot and shard of every document."""
    return sharding.with_shard(documents(spark, sf_dir), "doc_id", SHARDS)


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice and base log10 probability of every document."""
    return lattice.score(documents(spark, sf_dir))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return line_quality.score(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 2,048 ids."""
    made = packing.pack(documents(spark, sf_dir))
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector."""
    return metric_join.link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block and slot of every document, by source weights."""
    made = mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return made.select("doc_id", "source", F.col("_block").alias("block"), F.col("_slot").alias("slot"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.report(documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return licenses.scan(documents(spark, sf_dir))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return jaccard_join.classes(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to token files and read back."""
    return token_files.round_trip(documents(spark, sf_dir)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page, with the trust and distrust of its host."""
    return link_trust.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), URL_RULES).drop("url", "html")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes in each language, by order and step."""
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents whose id's checksum ends in 0 repeat some of their words up to the end."""
    h, text = F.crc32(F.col("doc_id").cast("string")), F.coalesce("text", F.lit(""))
    words = F.when(h % 10 == 0, F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    g, rest = F.floor(h / 10), F.col("_n") - F.col("_a")
    made = docs.select("doc_id", text.alias("text"), words.alias("_words"), g.alias("_g")).withColumn("_n", F.when(F.col("_words").isNotNull(), F.size("_words")))
    made = made.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    made = made.withColumn("_p", (1 + F.floor(rest / (3 + F.col("_g") % 8))).cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest)
    return made.select("doc_id", F.when(F.col("_n") > 0, F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document: their number, the longest one, and digests of all of them and of what they leave."""
    made = word_runs.find(with_planted_runs(documents(spark, sf_dir)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    return made.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.back")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.short")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.short")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_lattice": op1_lattice,
    "op2_line_quality": op2_line_quality,
    "op3_packing": op3_packing,
    "op4_metric_join": op4_metric_join,
    "op5_mixing": op5_mixing,
    "op6_pii": op6_pii,
    "op7_sharding": op7_sharding,
    "op8_licenses": op8_licenses,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_token_files": op10_token_files,
    "op11_link_trust": op11_link_trust,
    "op12_filter_audit": op12_filter_audit,
    "op13_word_runs": op13_word_runs,
}



def _link_trust_sql() -> str:
    """The rounds of op11 one after another, in whole numbers as there."""
    url, lower, unit = r"regexp_extract({}, '(?s)^.*?://([^/?#]*)', 1)", "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", link_trust.UNIT
    host = lambda x: lower.format(url.format(x))
    rules = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda k: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{(h + p, v)[k]}'" for h, p, v in rules) + " END"
    rounds = ", ".join(
        f"v{k + 1} AS MATERIALIZED (SELECT side, host, sum(value)::BIGINT AS value FROM (SELECT * FROM v0 UNION ALL SELECT f.side, f.dst, floor({link_trust.DAMPING}::DOUBLE * v.value * f.share)::BIGINT FROM flows f JOIN v{k} v ON f.side = v.side AND f.src = v.host) GROUP BY ALL HAVING sum(value) > 0)"
        for k in range(link_trust.ROUNDS)
    )
    pattern = link_trust.LINK.replace("'", "''")
    return f"""
        WITH p AS MATERIALIZED (SELECT page_id, html, {host("coalesce(url, '')")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        r AS MATERIALIZED (SELECT page_id, host, path, {case(0)} AS rule, {case(1)} AS verdict FROM p),
        l AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{pattern}', 1), lambda x: {host("regexp_replace(x, '^//', '://')")}))) AS dst FROM p),
        e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
        flows AS MATERIALIZED (SELECT 0 AS side, src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM e UNION ALL SELECT 1, dst, src, n / sum(n) OVER (PARTITION BY dst) FROM e),
        s AS (SELECT host, floor({unit}::DOUBLE * (count(*) FILTER (verdict = 'allow') / count(*)))::BIGINT AS t, floor({unit}::DOUBLE * (count(*) FILTER (verdict = 'block') / count(*)))::BIGINT AS d FROM r WHERE host <> '' GROUP BY host),
        v0 AS MATERIALIZED (SELECT * FROM (SELECT 0 AS side, host, t AS value FROM s UNION ALL SELECT 1, host, d FROM s) WHERE value > 0), {rounds},
        h AS (SELECT host, coalesce(sum(value) FILTER (side = 0), 0)::BIGINT AS trust, coalesce(sum(value) FILTER (side = 1), 0)::BIGINT AS distrust FROM v{link_trust.ROUNDS} GROUP BY host)
        SELECT page_id, r.host, path, rule, coalesce(verdict, CASE WHEN distrust >= {int(link_trust.LIMIT * unit)} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
          coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM r LEFT JOIN h ON r.host = h.host
    """


_SLOTS = ",".join(map(str, sharding.fill_table(SHARDS)))

ORACLES = {
    "op11_link_trust": _link_trust_sql(),
    "op12_filter_audit": r"""
        WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        m AS (SELECT part, doc_id, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t))::INT
          + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask FROM w),
        c AS MATERIALIZED (SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM m LEFT JOIN labels USING (doc_id) GROUP BY ALL),
        o(f) AS (SELECT '' UNION ALL SELECT f || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(x) WHERE NOT contains(f, x)),
        s AS (SELECT f AS filter_order, step, 1 << (ascii(f[step]) - 65) AS bit, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(f[i]) - 65))), 0)::INT AS before
          FROM o, unnest([1, 2, 3, 4, 5]) AS u(step) WHERE len(f) = 5),
        r AS (SELECT * FROM s, c)
        SELECT part, filter_order, step::INTEGER AS step, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
          coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
          coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
          coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost, coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit > 0), 0)::BIGINT AS shapley
        FROM r GROUP BY part, filter_order, step
    """,
    "op7_sharding": f"""
        SELECT doc_id, slot::INTEGER AS slot, 'shard-' || lpad(string_split('{_SLOTS}', ',')[slot + 1], 2, '0') AS shard
        FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {sharding.TABLE_SIZE} AS slot FROM documents)
    """,
    "op4_metric_join": """
        WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
        l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS m FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
        FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
    """,
    "op9_jaccard_join": r"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
        e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
        l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
        SELECT doc_id, len(g)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM s LEFT JOIN c ON c.a = doc_id
    """,
}

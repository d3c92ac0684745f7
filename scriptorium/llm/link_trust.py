"""URL verdicts by rules, and by trust and distrust that spread over links between hosts.

A rule names a host and a start of the path; it fits its host and all subdomains, and
the longest fitting rule decides. Where none fits, the host decides: hosts with pages
that rules allow are trusted seeds, hosts with blocked pages distrusted ones (by the
share of their pages). Trust goes along the links (personalised PageRank from the
trusted seeds), distrust against them, to those that link to blocked hosts. A host is
blocked if its distrust reaches ``LIMIT`` and exceeds its trust.

Ranks are whole numbers, ``UNIT`` for one seed, and each share that an edge carries is
cut to a whole number, so sums don't depend on the order of tasks: a retried task, and
SQL, give the same ranks. A round is a join with the edges and a sum with partial sums
in front of its shuffle; it's written to the shared folder. Nothing but two numbers a
round reaches the driver. Rounds end when a round changes nothing, at ``ROUNDS`` at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import discard, fresh, lower_ascii, written

UNIT, DAMPING, ROUNDS, LIMIT = 1_000_000_000, 0.85, 24, 0.5

#: Anchors whose target names a host.
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s\"'>]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without one, or null, empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, of equal ones that of the longer host; null where none does."""
    rule = verdict = F
    for name, start, what in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]))):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = rule.when(fits, F.lit(name + start)), verdict.when(fits, F.lit(what))
    return (F.lit(None).cast("string"),) * 2 if rule is F else (rule, verdict)


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): pages of host src that link to another host dst."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)), lambda x: host_of(F.regexp_replace(x, "^//", "://"))))
    pairs = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(found).alias("dst"))
    return pairs.filter("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of every host that a seed reaches.

    ``seeds``: host, trust, distrust in units (long), a row a host. ``edges``: src, dst,
    n > 0, a row a pair; no edges leave the seeds as they are. A host's outgoing rank is
    dealt by n; a host without links keeps nothing and passes nothing on.
    """
    both = edges.select(F.lit(0).alias("side"), "src", "dst", "n").union(edges.select(F.lit(1).alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    total = both.groupBy("side", "src").agg(F.sum("n").alias("total"))
    flows = written(both.join(total, ["side", "src"]).select("side", "src", "dst", (F.col("n") / F.col("total")).alias("share")), "trust-flows")
    start = seeds.select("host", F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(c).alias("value")) for k, c in enumerate(("trust", "distrust"))))).alias("s"))
    start = written(start.select("s.side", "host", "s.value").filter("value > 0"), "trust-seeds")
    now, mark = start, None
    for _ in range(rounds):
        moved = flows.join(now, (flows.side == now.side) & (flows.src == now.host)).select(flows.side, flows.dst.alias("host"), F.floor(DAMPING * F.col("value") * F.col("share")).alias("value"))
        after = written(start.union(moved).groupBy("side", "host").agg(F.sum("value").alias("value")).filter("value > 0"), "trust-round")
        seen = after.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("side", "host", "value"), F.lit(1 << 40)))).first()
        if now is not start:
            discard(now)
        now = after
        if seen == mark:
            break
        mark = seen
    value = lambda k: F.sum(F.when(F.col("side") == k, F.col("value")).otherwise(0))
    return now.groupBy("host").agg(value(0).alias("trust"), value(1).alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", html_col: str = "html", limit: float = LIMIT) -> DataFrame:
    """The pages' columns with host, path, rule, verdict, trust and distrust of the host.

    ``rules``: (host, start of the path, allow or block). A null url, or one without
    ``://``, has an empty host and path; an empty host, and one that no seed reaches, has
    no trust and no distrust and is allowed. A null html has no links, repeated rows are
    judged each, an empty table gives an empty one. A column of pages called like one of
    the results gives way to it. The join with the hosts' ranks is by host; adaptive
    execution splits a host with many pages.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    places = pages.select(host.alias("host"), path.alias("path")).select("host", verdict.alias("verdict")).filter("host <> ''")
    share = lambda what: F.floor(F.lit(float(UNIT)) * (F.count(F.when(F.col("verdict") == what, 1)) / F.count("*"))).alias({"allow": "trust", "block": "distrust"}[what])
    ranks = spread(places.groupBy("host").agg(share("allow"), share("block")), links(pages, url_col, html_col))
    at, mine = fresh("_host", pages), ["host", "path", "rule", "verdict", "trust", "distrust"]
    ranks = ranks.withColumnRenamed("host", at)
    kept = pages.withColumns({"host": host, "path": path})
    kept = kept.withColumns({"rule": rule, "_verdict": verdict}).drop("trust", "distrust", "verdict")
    joined = kept.join(ranks, kept["host"] == ranks[at], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("trust", "distrust")})
    bad = (F.col("distrust") >= int(limit * UNIT)) & (F.col("distrust") > F.col("trust"))
    out = joined.withColumn("verdict", F.coalesce("_verdict", F.when(bad, "block").otherwise("allow")))
    return out.select(*(c for c in pages.columns if c not in mine), *mine)

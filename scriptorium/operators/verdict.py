"""Findings: routing, order, caps, counts, coverage, exceptions, gate scope, rule diffs, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T

#: Every finding code with its severity (E, W or I) and lane ("fix": an attached command).
ROUTES = """
source-path-missing E source-review
source-path-kind E source-review
source-path-unmeasured W source-review
page-too-large E syntax-review
page-not-utf8 E syntax-review
malformed-frontmatter E syntax-review
frontmatter-not-mapping E syntax-review
duplicate-key E syntax-review
type-unknown E type-review
abstract-type E type-review
page-shape-invalid E syntax-review
page-ref-type E link-review
vocabulary-unknown E category-review
vocabulary-retired E category-review
identity-collision E identity-review
wikilink-unresolved W link-review
wikilink-alias-target E link-review
renamed-without-alias E identity-review
path-skipped W identity-review
instances-min E type-review
instances-max E type-review
section-count E grammar-review
section-order E grammar-review
section-undeclared E grammar-review
section-depth E grammar-review
item-unparsed E grammar-review
category-not-allowed E category-review
claim-provenance E provenance-backfill
claim-closed E grammar-review
claim-open E grammar-review
relation-target-unresolved W link-review
require-unmet E label-review
entry-edited E grammar-review
claims-transition E grammar-review
relation-removed E label-review
folder-segment-registered E tag-review
folder-tags-present E fix
former-folder-tags-review W tag-review
exception-applied I -
exception-stale W exception-review
exception-illegal E exception-review
rule-error E rule-review
unevaluated I -
rule-untested W rule-review
rule-test-fails E rule-review
example-fails E rule-review
law-changed I -
law-relaxed E law-review
generated-drift E fix
okf-missing-type E type-review
pin-stale W source-review
pin-unknown W source-review
pin-coverage-invalid W source-review
pin-unmeasured I -
citation-unresolved W source-review
stale-source-cited W source-review
""".split("\n")[1:-1]

#: Codes that a page may not waive, that the gate never demotes, whose findings depend on names, that stand on no one page.
NEVER_WAIVED = "page-too-large page-not-utf8 malformed-frontmatter frontmatter-not-mapping duplicate-key identity-collision instances-min instances-max rule-error exception-stale exception-illegal rule-untested rule-test-fails example-fails law-relaxed".split()
NEVER_DEMOTED = "page-too-large page-not-utf8 malformed-frontmatter frontmatter-not-mapping duplicate-key identity-collision instances-min instances-max exception-illegal".split()
NAME_READERS = "wikilink-unresolved wikilink-alias-target relation-target-unresolved page-ref-type rule-error".split()
VAULT_WIDE = "identity-collision instances-min instances-max path-skipped".split()
TRANSITIONS = "renamed-without-alias entry-edited claims-transition relation-removed former-folder-tags-review".split()
SEVERITIES = {"E": "error", "W": "warning", "I": "info"}


def routes(spark) -> DataFrame:
    """(rule, severity, lane): one row per code."""
    rows = [(r, SEVERITIES[s], None if lane == "-" else lane) for r, s, lane in (x.split() for x in ROUTES)]
    return spark.createDataFrame(rows, "rule string, severity string, lane string")


#: Commands that mend a finding, and the detail that must be true for it; without it the lane stands.
FIXES = {"folder-tags-present": (["scriptorium", "check", "--fix"], "materialize", "tag-review"), "generated-drift": (["scriptorium", "check", "--write"], None, None)}


def route(findings: DataFrame, table: DataFrame, own_lane: str = "rule-review") -> DataFrame:
    """Findings with severity from the table (56 rows), and either the queue lane or the command that mends them (``fix``).

    An own rule keeps its severity and goes to ``own_lane``; info has neither.
    """
    own = F.col("severity") if "severity" in findings.columns else F.lit("error")
    found = findings.withColumn("_own", own).drop("severity").join(F.broadcast(table), "rule", "left")
    severity = F.coalesce("severity", "_own")
    fix, lane = F.lit(None).cast("array<string>"), F.coalesce("lane", F.lit(own_lane))
    for rule, (argv, needs, other) in FIXES.items():
        holds = F.lit(True) if needs is None else F.coalesce(F.col("details")[needs] == "true", F.lit(False)) if "details" in findings.columns else F.lit(False)
        fix = F.when((F.col("rule") == rule) & holds, F.array(*map(F.lit, argv))).otherwise(fix)
        lane = F.when(F.col("rule") == rule, F.when(~holds, F.lit(other))).otherwise(lane)
    found = found.withColumns({"queue": F.when(severity != "info", lane), "fix": F.when(severity != "info", fix), "severity": severity})
    return found.drop("lane", "_own")


def display_order() -> list[Column]:
    """Path, place (page, then line, then heading and occurrence), rule, message; texts by code units."""
    return [T.code_units(F.col("path")), F.coalesce("line", F.lit(-1)), T.code_units(F.coalesce("heading", F.lit(""))), F.coalesce("occurrence", F.lit(-1)), F.col("rule"), T.code_units(F.col("message"))]


def band(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def cap(findings: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` first findings by severity, then display order: a top-k, no shuffle of all rows."""
    return findings.orderBy(band(F.col("severity")), *display_order()).limit(limit).orderBy(*display_order())


def by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule", "severity").agg(F.count("*").alias("findings"))


def totals(findings: DataFrame) -> DataFrame:
    return findings.agg(*(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")))


def coverage(pages: DataFrame, rules: DataFrame, governed: DataFrame, unjudged: DataFrame) -> DataFrame:
    """(rule, evaluated, not_applicable, unevaluated) over pages (path, type).

    ``governed``: (type, rule) pairs; ``unjudged``: (path, rule) that couldn't be judged, which beats judged.
    Counts are taken by type first, so nothing grows with pages times rules.
    """
    by_type = pages.groupBy("type").agg(F.count("*").alias("n"))
    total = pages.agg(F.count("*").alias("total"))
    held = governed.join(by_type, "type").groupBy("rule").agg(F.sum("n").alias("held"))
    missed = unjudged.join(pages, "path").join(governed, ["type", "rule"], "left_semi").select("rule", "path").distinct().groupBy("rule").agg(F.count("*").alias("missed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    # one row of totals
    out = rules.select("rule").join(held, "rule", "left").join(missed, "rule", "left").join(F.broadcast(total))
    return out.select("rule", (zero("held") - zero("missed")).alias("evaluated"), (F.col("total") - zero("held")).alias("not_applicable"), zero("missed").alias("unevaluated"))


def unevaluated_reasons(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rule").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def filtered(findings: DataFrame, rule: str | None = None, path: str | None = None) -> DataFrame:
    """Findings of one rule, of one path or below one folder; taken before any cap."""
    if rule:
        findings = findings.filter(F.col("rule") == rule)
    if path:
        findings = findings.filter((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/"))
    return findings


def excepted(findings: DataFrame) -> DataFrame:
    """(rule, excepted): applied exceptions by the rule that they waive."""
    return findings.filter("rule = 'exception-applied'").groupBy(F.col("details")["rule"].alias("rule")).agg(F.count("*").alias("excepted"))


def judged_waivers(waivers: DataFrame, known_rules: DataFrame) -> DataFrame:
    """Waivers with ``illegal``: no rule of this law, a census, or a rule that a page may not waive; null if legal."""
    known = known_rules.select("rule", F.col("severity").alias("_severity"), F.lit(True).alias("_known"))
    why = F.when(F.col("_known").isNull(), "names no rule this law has").when(F.col("_severity") == "info", "names a census").when(F.col("rule").isin(*NEVER_WAIVED), "names a law that a page may not waive")
    return waivers.join(F.broadcast(known), "rule", "left").withColumn("illegal", why).drop("_severity", "_known")  # rules: bounded by the law


def exceptions(findings: DataFrame, waivers: DataFrame, known_rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings left, rows on the waivers): applied, stale or illegal. Waivers: (path, rule); illegal ones waive nothing."""
    judged = judged_waivers(waivers, known_rules)
    legal = judged.filter("illegal is null").select("path", "rule").distinct()
    left = findings.join(legal, ["path", "rule"], "left_anti")
    hit = findings.select("path", "rule").distinct().withColumn("hit", F.lit(True))
    told = judged.join(hit, ["path", "rule"], "left")
    code = F.when(F.col("illegal").isNotNull(), "exception-illegal").when(F.col("hit").isNull(), "exception-stale").otherwise("exception-applied")
    return left, told.select("path", F.col("rule").alias("waived"), code.alias("rule"))


def apply_exceptions(findings: DataFrame, waivers: DataFrame, known_rules: DataFrame, unjudged: DataFrame) -> DataFrame:
    """Findings with each waived one turned into ``exception-applied``, and rows for stale and illegal waivers.

    Waivers: (path, rule, reason, index), the first of a rule holds. One whose rule couldn't be judged on the page
    (``unjudged``: path, rule) is neither applied nor stale. Info findings can't be waived. Findings stream by a hash table
    of the waivers, which are fewer, and are never sorted.
    """
    judged = judged_waivers(waivers, known_rules)
    legal = judged.filter("illegal is null").join(unjudged.select("path", "rule").distinct().hint("shuffle_hash"), ["path", "rule"], "left_anti")
    first = legal.groupBy("path", "rule").agg(F.min(F.struct("index", "reason")).alias("_w")).hint("shuffle_hash")
    hit = findings.join(first, ["path", "rule"], "left").withColumn("_on", F.col("_w").isNotNull() & (F.col("severity") != "info"))
    details = F.create_map(F.lit("rule"), F.col("rule"), F.lit("reason"), F.col("_w.reason"), F.lit("pointer"), F.concat(F.lit("/exceptions/"), F.col("_w.index").cast("string")), F.lit("severity"), F.col("severity"), F.lit("message"), F.col("message"))
    swap = {
        "details": F.when(F.col("_on"), details).otherwise(F.col("details")), "message": F.when(F.col("_on"), F.concat("rule", F.lit(", waived: "), "_w.reason")).otherwise(F.col("message")),
        "severity": F.when(F.col("_on"), "info").otherwise(F.col("severity")), "rule": F.when(F.col("_on"), "exception-applied").otherwise(F.col("rule")),
    }
    out = hit.select(*(swap.get(c, F.col(c)).alias(c) for c in findings.columns))
    held = findings.filter("severity <> 'info'").select("path", "rule").join(first, ["path", "rule"], "left_semi")
    stale = legal.join(held.hint("shuffle_hash"), ["path", "rule"], "left_anti").select("path", F.lit("exception-stale").alias("code"), F.lit("warning").alias("s"), "rule", "index", F.lit("closes no finding on this page").alias("why"))
    illegal = judged.filter("illegal is not null").select("path", F.lit("exception-illegal"), F.lit("error"), "rule", "index", "illegal")
    told = stale.union(illegal)
    place = [F.lit(None).cast(findings.schema[c].dataType).alias(c) for c in ("line", "heading", "occurrence")]
    about = F.create_map(F.lit("rule"), F.col("rule"), F.lit("pointer"), F.concat(F.lit("/exceptions/"), F.col("index").cast("string")))
    rows = told.select("path", F.col("code").alias("rule"), F.col("s").alias("severity"), *place, F.concat(F.lit("the exception for "), "rule", F.lit(" "), "why").alias("message"), about.alias("details"))
    return out.unionByName(rows)


def key() -> Column:
    """What makes two findings of two runs the same: rule, path, place, details."""
    return F.concat_ws("\0", "rule", "path", F.coalesce(F.col("line").cast("string"), F.lit("")), F.coalesce("heading", F.lit("")), F.coalesce(F.col("occurrence").cast("string"), F.lit("")), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce("details", F.create_map().cast("map<string,string>")))))))


def caused_by_names(findings: DataFrame, before: DataFrame, users: DataFrame, readers: list[str]) -> DataFrame:
    """Findings with ``caused``: those of ``readers`` on pages (users: path) that write a changed name, which the same pages don't have under the base's names (``before``)."""
    old = before.select(key().alias("_k")).distinct().withColumn("_same", F.lit(True))
    named = findings.join(users.select("path", F.lit(True).alias("_user")), "path", "left").withColumn("_k", key()).join(old, "_k", "left")
    caused = F.col("rule").isin(*readers) & F.col("_user").isNotNull() & F.col("_same").isNull()
    return named.withColumn("caused", caused).select(*findings.columns, "caused")


def gate_scope(findings: DataFrame, inherited: DataFrame, touched: DataFrame, vault_wide: list[str], sections: DataFrame | None = None, transitions: list[str] = ()) -> DataFrame:
    """Findings of touched pages and vault-wide rules; queued errors that a page inherits become warnings with ``demoted_from``.

    A finding on the line of a section's heading is the section's: it is inherited if the section is unchanged
    (``sections``: path, heading, occurrence, line, unchanged). Any other is if its line is (``inherited``: path, line).
    Transitions, own rules among them (``transitions``), and findings that no page can inherit keep their severity. A
    column ``caused`` (boolean), if there is one, keeps a finding of an untouched page, undemoted: a name or a source path
    changed elsewhere.
    """
    caused = F.col("caused") if "caused" in findings.columns else F.lit(False)
    wide = F.col("rule").isin(*vault_wide)
    kept = findings.withColumn("_c", caused).join(touched.select("path", F.lit(True).alias("_t")), "path", "left").filter(F.col("_t").isNotNull() | wide | F.col("_c")).drop("_t")
    old = kept.join(inherited.select("path", "line", F.lit(True).alias("_old")), ["path", "line"], "left")
    by_line = F.col("_old").isNotNull()
    if sections is not None:
        old = old.join(sections.select("path", "heading", "occurrence", "line", F.col("unchanged").alias("_same")), ["path", "heading", "occurrence", "line"], "left")
        by_line = F.coalesce("_same", by_line)
    fixed = F.col("rule").isin(*NEVER_DEMOTED, *TRANSITIONS, *transitions)
    if transitions:
        fixed = fixed | ((F.col("rule") == "rule-error") & F.coalesce(F.col("details")["rule"].isin(*transitions), F.lit(False)))
    demote = by_line & (F.col("severity") == "error") & F.col("queue").isNotNull() & ~fixed & ~F.col("_c")
    return old.withColumn("demoted_from", F.when(demote, "error")).withColumn("severity", F.when(demote, "warning").otherwise(F.col("severity"))).select(*(c for c in findings.columns if c != "caused"), "demoted_from")


def drift(planned: DataFrame, held: DataFrame) -> DataFrame:
    """(path, missing) of generated files (path, content) that are absent or differ from what is held."""
    own = held.select("path", F.col("content").alias("_held"), F.lit(True).alias("_is"))
    return planned.join(own, "path", "left").filter(~F.col("content").eqNullSafe(F.col("_held"))).select("path", F.col("_is").isNull().alias("missing"))


def regressions(now: DataFrame, before: DataFrame, touched: DataFrame) -> DataFrame:
    """Findings of a judged write that count: those on touched pages, and those that the state before didn't have."""
    old = before.select(key().alias("_k")).distinct()
    keyed = now.withColumn("_k", key()).join(touched.select("path", F.lit(True).alias("_t")), "path", "left")
    new = keyed.filter("_t is null").join(old, "_k", "left_anti")
    return keyed.filter("_t is not null").unionByName(new).drop("_k", "_t")


def scope_coverage(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: sections by mode (governed, prose, unbound), records read, items not read, pages with text before their first heading."""
    by = sections.agg(
        *(F.count_if(c).alias(n) for n, c in (("governed", ~F.col("mode").isin("prose", "unbound")), ("prose", F.col("mode") == "prose"), ("unbound", F.col("mode") == "unbound"))),
        F.coalesce(F.sum("records"), F.lit(0)).alias("parsed_records"), F.coalesce(F.sum("unread"), F.lit(0)).alias("malformed_items"),
    )
    return by.join(F.broadcast(pages.agg(F.count_if(F.trim(F.coalesce("preamble", F.lit(""))) != "").alias("unbound_preambles"))))  # one row each


def diff(before: DataFrame, after: DataFrame, keys: list[str], shape: Column) -> DataFrame:
    """Full outer difference of two declarations: (keys, change) with change added, removed or changed."""
    a = before.select(*keys, F.to_json(shape).alias("_a"))
    b = after.select(*keys, F.to_json(shape).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, keys, "full").withColumn("change", change).filter("change is not null").select(*keys, "change")


def content_digest(pages: DataFrame) -> DataFrame:
    """One row, digest: SHA-256 over the sorted "path NUL sha256(content)" lines of pages (path, content).

    The digest is defined over one sorted list, so one task takes it; it sorts on disk where it must and hashes the lines
    in a stream, so its memory doesn't grow with the pages.
    """
    lines = pages.select(F.concat("path", F.lit("\0"), F.sha2("content", 256), F.lit("\n")).cast("binary").alias("line"))

    def run(batches):
        import hashlib

        import pyarrow as pa

        own = hashlib.sha256()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                own.update(x)
        yield pa.RecordBatch.from_arrays([pa.array([own.hexdigest()])], ["digest"])

    return lines.repartition(1).sortWithinPartitions("line").mapInArrow(run, "digest string")


def budget(rows: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """Rows of each group in order while their sizes fit ``most``; after the first that doesn't, none."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= most)

"""Name index, link resolution, references and identity collisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T


def spellings(pages: DataFrame, title_is_name: bool = False) -> DataFrame:
    """(name, path, type, kind): kind 0 the base name, 1 an alias, 2 the title if it counts as a name."""
    base = pages.select(T.basename(F.col("path")).alias("name"), "path", "type", F.lit(0).alias("kind"))
    aliases = pages.select(F.explode("aliases").alias("name"), "path", "type", F.lit(1).alias("kind"))
    out = base.union(aliases)
    if title_is_name:
        out = out.union(pages.filter("title is not null").select(F.col("title").alias("name"), "path", "type", F.lit(2).alias("kind")))
    return out.withColumn("ident", T.ident(F.trim("name")))


def name_index(pages: DataFrame) -> DataFrame:
    """(ident, target, target_type, via_alias): base names first, the last page of one wins; then aliases that are free, the first page wins."""
    s = spellings(pages).withColumn("side", F.when(F.col("kind") == 0, F.struct(F.lit(1).alias("a"), F.col("path").alias("b"))))
    best = s.groupBy("ident").agg(F.max("side.b").alias("own"), F.min(F.when(F.col("kind") == 1, F.col("path"))).alias("alias"), F.max_by("type", F.struct(F.when(F.col("kind") == 0, 1).otherwise(0), F.col("path"))).alias("own_type"), F.min_by("type", F.struct(F.when(F.col("kind") == 1, 0).otherwise(1), F.col("path"))).alias("alias_type"))
    return best.select("ident", F.coalesce("own", "alias").alias("target"), F.when(F.col("own").isNotNull(), F.col("own_type")).otherwise(F.col("alias_type")).alias("target_type"), F.col("own").isNull().alias("via_alias"))


def name_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(ident, change) of the keys that two name indexes don't answer alike: added, removed or moved to another page, type or way."""
    side = lambda d, name: d.select("ident", F.struct("target", "target_type", "via_alias").alias(name))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("moved")
    return side(now, "_a").join(side(before, "_b"), "ident", "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("ident", change.alias("change"))


def base_pages(pages: DataFrame, moves: DataFrame, removed: DataFrame) -> DataFrame:
    """Pages of the state before, at the paths that they had there: pages (path, ...) as they stand now, moves (path, renamed_from), and those that are gone."""
    was = pages.join(moves.filter("renamed_from is not null").select("path", "renamed_from"), "path", "left")
    return was.withColumn("path", F.coalesce("renamed_from", "path")).drop("renamed_from").unionByName(removed)


def name_users(written: DataFrame, changes: DataFrame) -> DataFrame:
    """(path) of the pages that write one of the changed keys; written: (path, ident)."""
    return written.join(changes.select("ident"), "ident", "left_semi").select("path").distinct()


def resolve(links: DataFrame, index: DataFrame, target: str = "target_name") -> DataFrame:
    """``links`` with target, target_type, via_alias and verdict (resolved, alias, unresolved).

    A plain equi-join on the identity key: the optimizer broadcasts a small index and adaptive execution splits a hot name.
    """
    keyed = links.withColumn("ident", T.ident(F.trim(F.col(target))))
    verdict = F.when(F.col("target").isNull(), "unresolved").when(F.col("via_alias"), "alias").otherwise("resolved")
    return keyed.join(index, "ident", "left").withColumn("verdict", verdict)


def resolve_as(rows: DataFrame, index: DataFrame, name: str, column: str) -> DataFrame:
    """``rows`` with the path that a name column stands for in ``column``, null if it names no page."""
    keyed = rows.withColumn("_ident", T.ident(F.trim(F.col(name))))
    return keyed.join(index.select(F.col("ident").alias("_ident"), F.col("target").alias(column)), "_ident", "left").drop("_ident")


def collisions(pages: DataFrame, title_is_name: bool = False) -> DataFrame:
    """(ident, path, kind, owner): spellings that another page owns; base names own before aliases, aliases before titles, then the smaller path."""
    s = spellings(pages, title_is_name)
    if title_is_name:  # a title equal to the page's own base name is no second claim
        s = s.filter((F.col("kind") != 2) | (F.col("ident") != T.ident(T.basename(F.col("path")))))
    owners = s.groupBy("ident").agg(F.min(F.struct("kind", "path")).alias("o"))
    return s.join(owners, "ident").filter(F.col("path") != F.col("o.path")).select("ident", "path", "kind", F.col("o.path").alias("owner")).distinct()


def reference_findings(refs: DataFrame, index: DataFrame, chains: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """Refs (path, field, target_name, required) that name no page, a page of another type chain, or one outside ``roots``.

    ``chains``: (type, chain) with chain the type and its ancestors.
    """
    found = resolve(refs, index).join(chains.withColumnRenamed("type", "target_type"), "target_type", "left")
    outside = F.lit(False) if not roots else ~F.exists(F.array(*map(F.lit, roots)), lambda r: F.col("target").startswith(F.concat(r, F.lit("/"))))
    kind = (
        F.when(F.col("target_name").contains("/"), "is-path").when(F.col("target").isNull(), "unresolved")
        .when(F.col("required").isNotNull() & ~F.array_contains(F.coalesce("chain", F.array().cast("array<string>")), F.col("required")), "wrong-type").when(outside, "wrong-root")
    )
    return found.withColumn("kind", kind).filter("kind is not null").select("path", "field", "target_name", "target", "kind")


def vocabulary_findings(values: DataFrame, vocabulary: DataFrame, mode: str = "registered") -> DataFrame:
    """(…, code, successor) of values whose entry is retired, or unknown in a registered vocabulary. vocabulary: (entry, status, successor)."""
    found = values.join(vocabulary, F.col("value") == F.col("entry"), "left")
    code = F.when(F.col("status") == "retired", "vocabulary-retired").when(F.col("entry").isNull() & F.lit(mode == "registered"), "vocabulary-unknown")
    return found.withColumn("code", code).filter("code is not null").select(*values.columns, "code", "successor")


def census(*used: tuple[str, DataFrame]) -> DataFrame:
    """(vocabulary, value, uses) of (name, values) pairs, most used first."""
    rows = None
    for name, values in used:
        own = values.select(F.lit(name).alias("vocabulary"), F.col("value").cast("string").alias("value"))
        rows = own if rows is None else rows.union(own)
    return rows.groupBy("vocabulary", "value").agg(F.count("*").alias("uses")).orderBy("vocabulary", F.desc("uses"), "value")


def instance_findings(pages: DataFrame, chains: DataFrame, bounds: DataFrame) -> DataFrame:
    """(type, pages, code) of types with fewer or more pages, subtypes' included, than (type, least, most) allows."""
    counted = pages.groupBy("type").agg(F.count("*").alias("n")).join(chains, "type").select(F.explode("chain").alias("type"), "n").groupBy("type").agg(F.sum("n").alias("pages"))
    all_ = bounds.join(counted, "type", "left").withColumn("pages", F.coalesce("pages", F.lit(0)).cast("long"))
    code = F.when(F.col("pages") < F.col("least"), "instances-min").when(F.col("pages") > F.col("most"), "instances-max")
    return all_.withColumn("code", code).filter("code is not null").select("type", "pages", "code")


def location_at(points: DataFrame, headings: DataFrame) -> DataFrame:
    """Points (path, line) with the heading they stand under (the last one at or before the line) and its index among equal headings."""
    numbered = headings.withColumn("occurrence", F.row_number().over(Window.partitionBy("path", "heading").orderBy("line")) - 1)
    both = numbered.select("path", "line", F.lit(0).alias("side"), F.struct("heading", "occurrence").alias("at")).unionByName(points.select("path", "line", F.lit(1).alias("side")), allowMissingColumns=True)
    w = Window.partitionBy("path").orderBy("line", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("at", F.last("at", ignorenulls=True).over(w)).filter("side = 1").select("path", "line", "at.heading", "at.occurrence")


def edges(*kinds: DataFrame) -> DataFrame:
    """Distinct (from, to, kind, label) edges without loops."""
    rows = kinds[0]
    for more in kinds[1:]:
        rows = rows.unionByName(more)
    return rows.filter(F.col("from") != F.col("to")).dropDuplicates(["from", "to", "kind", "label"])


def edge_counts(graph: DataFrame) -> DataFrame:
    """(kind, label, edges): by kind (label null), and relations by label."""
    by_kind = graph.groupBy("kind").agg(F.count("*").alias("edges")).select("kind", F.lit(None).cast("string").alias("label"), "edges")
    return by_kind.union(graph.filter("kind = 'relation'").groupBy("kind", "label").agg(F.count("*").alias("edges")))


def neighbours(graph: DataFrame) -> DataFrame:
    """Distinct (page, direction, kind, label, other): each edge from both of its ends."""
    out = graph.select(F.col("from").alias("page"), F.lit("out").alias("direction"), "kind", "label", F.col("to").alias("other"))
    return out.union(graph.select("to", F.lit("in"), "kind", "label", "from")).distinct()


def adjacency(graph: DataFrame) -> DataFrame:
    """(page, direction, kind, label, neighbours sorted), for a rendered manifest; a corpus with hubs keeps ``neighbours`` as rows."""
    return neighbours(graph).groupBy("page", "direction", "kind", "label").agg(F.array_sort(F.collect_list("other")).alias("neighbours"))


def stale_propagation(graph: DataFrame, stale: DataFrame) -> DataFrame:
    """(path, via) of pages one hop before a stale page, tags aside."""
    return graph.filter("kind <> 'tagged'").join(stale.select(F.col("path").alias("to")), "to", "left_semi").select(F.col("from").alias("path"), F.col("to").alias("via")).distinct()


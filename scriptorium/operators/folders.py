"""Folder tags: a page carries the tags of the folders that it lies in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T


def segments(path: Column, roots: list[str]) -> Column:
    """Folders between the first content root that holds the path and the file."""
    out = F.array().cast("array<string>")
    for r in reversed(roots):
        out = F.when(path.startswith(r + "/"), T.folder_segments(path, r)).otherwise(out)
    return out


def _keyed(rows: DataFrame, column: str, key: str) -> DataFrame:
    return rows.withColumn(key, T.segment_identity(column))


def folder_rows(pages: DataFrame, roots: list[str], aliases: dict[str, str], path: str = "path") -> DataFrame:
    """(path, tags, pos, segment, key): each folder of a page, by its alias where it has one."""
    rows = pages.select("path", "tags", F.posexplode(segments(F.col(path), roots)).alias("pos", "segment"))
    if aliases:
        known = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
        rows = rows.withColumn("segment", F.coalesce(F.try_element_at(known, "segment"), "segment"))
    return _keyed(rows, "segment", "key")


def tag_keys(pages: DataFrame) -> DataFrame:
    """(path, key) of the tags that pages carry."""
    return _keyed(pages.select("path", F.explode("tags").alias("_t")), "_t", "key").select("path", "key").distinct()


def unregistered(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, segment) of folders that name no entry (entry) of the tags vocabulary."""
    known = F.broadcast(_keyed(entries.select("entry"), "entry", "key").select("key").distinct())  # bounded by the law's documents
    return rows.join(known, "key", "left_anti").select("path", "segment")


def missing(rows: DataFrame, carried: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, missing): folder tags that a page lacks, in folder order and as the vocabulary spells them."""
    named = F.broadcast(_keyed(entries.select("entry"), "entry", "key").groupBy("key").agg(F.min("entry").alias("entry")))
    lacking = rows.join(carried, ["path", "key"], "left_anti").join(named, "key", "left")
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("entry", "segment").alias("tag"))))
    return lacking.groupBy("path").agg(ordered.alias("m")).select("path", F.col("m.tag").alias("missing"))


def former(before: DataFrame, now: DataFrame, carried: DataFrame) -> DataFrame:
    """(path, segment): tags that a moved page still carries for folders that it left. ``before``: folder rows of the old path."""
    left = before.join(now.select("path", "key").distinct(), ["path", "key"], "left_anti")
    return left.join(carried, ["path", "key"], "left_semi").select("path", "segment").distinct()

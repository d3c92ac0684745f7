"""States of a bundle: a settled read of the working tree, drafts laid over it, and parse results kept between runs."""

from __future__ import annotations

import datetime
import os
import unicodedata

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources import store

#: Seconds that a file must have rested for its stamp to tell that it is unchanged.
RESTED = 2


class StateChanged(RuntimeError):
    """What was read changed meanwhile, twice."""


def settled(files, spark: SparkSession, tries: int = 2) -> tuple[DataFrame, str]:
    """((path, content), its table): files as they stood at one time.

    ``files()``: rows (path, content, modificationTime, length), listed anew at each call. They are written once; then
    stamps are listed again, without contents, and must be the same. A file whose stamp is too young to be trusted is
    read again, and only such ones. StateChanged if something changed in each of the tries.
    """
    for _ in range(tries):
        began = datetime.datetime.now(datetime.UTC).timestamp() - RESTED
        held, path = store.kept(files().withColumn("sha", F.sha2("content", 256)), "state")
        stamps = files().select("path", F.struct("modificationTime", "length").alias("_now"))
        young = files().filter(F.col("modificationTime") >= F.timestamp_seconds(F.lit(began))).select("path", F.sha2("content", 256).alias("_sha"))
        both = held.select("path", "sha", F.struct("modificationTime", "length").alias("_was")).join(stamps, "path", "full").join(young, "path", "left")
        try:
            if both.filter(~F.col("_was").eqNullSafe(F.col("_now")) | (F.col("_sha") != F.col("sha"))).isEmpty():
                return held.select("path", "content"), path
        except (Py4JError, PySparkException):  # a file went while it was read
            pass
        store.drop(spark, path)
    raise StateChanged("state-changed-during-read")


def drafts(folder: str) -> list[tuple[str, bytes]]:
    """(path, content) of every page below a drafts folder, at the path that it mirrors."""
    out = []
    for at, names, files in os.walk(folder):
        names[:] = sorted(n for n in names if not os.path.islink(os.path.join(at, n)))
        for n in sorted(files):
            full = os.path.join(at, n)
            if n.endswith(".md") and not os.path.islink(full):
                with open(full, "rb") as f:
                    out.append((unicodedata.normalize("NFC", os.path.relpath(full, folder)), f.read()))
    return out


def overlay(disk: DataFrame, drafts: DataFrame, moves: list[tuple[str, str]] = ()) -> DataFrame:
    """(path, content, base_content, renamed_from): drafts (path, content) over the disk's pages, which are the base; a moved page's base is the page it was.

    A path that a move leaves is gone unless a draft stands there.
    """
    spark = disk.sparkSession
    renamed = spark.createDataFrame([(b, a) for a, b in moves], "path string, renamed_from string")
    own = drafts.select("path", F.col("content").alias("_draft"))
    left = disk.select("path", "content").join(renamed.select(F.col("renamed_from").alias("path")), "path", "left_anti")
    now = left.join(own, "path", "full").select("path", F.coalesce("_draft", "content").alias("content"))
    base = disk.select(F.col("path").alias("_base"), F.col("content").alias("base_content"))
    return now.join(F.broadcast(renamed), "path", "left").join(base, F.coalesce("renamed_from", "path") == F.col("_base"), "left").drop("_base")


def _generations(spark: SparkSession, at: str) -> list[str]:
    """Complete generations of a store's key, oldest first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in files.listStatus(hadoop(at))) if files.exists(hadoop(at)) else []
    return [f"{at}/{n}" for n in names if n.startswith("rows-") and files.exists(hadoop(f"{at}/{n}/_SUCCESS"))]


def cached_pages(spark: SparkSession, files: DataFrame, parse, folder: str, key: str) -> DataFrame:
    """Parsed rows of (path, content), read from the store where the same path, content and key (law and engine) were parsed before.

    Only the rest is parsed and added. Once most rows of the store are of contents that no page has any more, the rows
    in use are written to a new generation, and the old ones go when the next call has made its own.
    """
    keyed = files.select("path", "content", F.sha2("content", 256).alias("content_sha"))
    at = f"{folder.rstrip('/')}/{key}"
    held = _generations(spark, at)
    for old in held[:-1]:
        store.drop(spark, old)
    now = held[-1] if held else f"{at}/rows-0000"
    rows = lambda: spark.read.parquet(now)
    fresh = keyed.join(rows().select("path", "content_sha"), ["path", "content_sha"], "left_anti") if held else keyed
    parse(fresh.select("path", "content")).join(fresh.select("path", "content_sha"), "path").write.mode("append").parquet(now)
    live = lambda: rows().join(keyed.select("path", "content_sha"), ["path", "content_sha"], "left_semi").dropDuplicates(["path", "content_sha"])
    if held and rows().count() > 2 * keyed.count():
        after = f"{at}/rows-{int(now[-4:]) + 1:04d}"
        live().write.parquet(after)
        return spark.read.parquet(after).drop("content_sha")
    return live().drop("content_sha")

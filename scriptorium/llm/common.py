"""Session and table helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: words are the runs between these characters.
SPACES = "\t\n\x0b\x0c\r "


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir).

    Only where the session names none and runs in one process, as in local tests, a temporary one is set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="scriptorium-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Rows of a narrow table that are worth a file.
FILE_ROWS = 100_000


def written(df: DataFrame, what: str, compression: str = "zstd", rows: int | None = None) -> DataFrame:
    """Write to a table of the shared folder and read it: cuts the lineage and survives lost executors.

    ``rows``: about how many narrow rows there are; they go to no more files than that is worth, so small tables make few.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    made = df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))
    made.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path, None
    return out


def bucketed(df: DataFrame, key: str, what: str) -> DataFrame:
    """Write to a table of the shared folder in buckets of the key, in its order: joins by the key read it without a shuffle."""
    spark = df.sparkSession
    name, parts = f"{what}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = df.repartition(parts, key).write.format("parquet").bucketBy(parts, key).sortBy(key).option("compression", "zstd")
    path = f"{shared_dir(spark)}/{name}"
    made.option("path", path).saveAsTable(name)
    out = spark.read.table(name)
    out._stored = path, name
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` or ``bucketed`` made, once nothing reads it any more."""
    for df in tables:
        (path, name), sc = df._stored, df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        if name:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_ascii(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_or_empty(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def slices(texts: list, most: int = 1_000_000):
    """Ranges of a list of texts (or bytes) with about so many characters each, one text at least."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)

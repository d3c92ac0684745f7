"""The driver's tables as typed pages, links, relations, claims, entries and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: type is the language, tags are source and language, the first line is the title."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(
        F.concat(F.lit("wiki/"), "source", F.lit("/Doc "), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("lang").alias("type"),
        F.array("source", "lang").alias("tags"),
        F.array().cast("array<string>").alias("aliases"),
        F.get(F.split("text", "\n"), 0).alias("title"),
        F.when(F.col("quality") == 0, "retired").otherwise("active").alias("status"),
        F.col("text").alias("body"),
    )


#: Types of the entity pages and their chains.
CHAINS = [("region", ["region", "place", "entity"]), ("nation", ["nation", "place", "entity"]), ("customer", ["customer", "party", "entity"]), ("supplier", ["supplier", "party", "entity"]), ("part", ["part", "entity"]), ("order", ["order", "entity"])]


def chains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHAINS, "type string, chain array<string>")


def entity_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, type, aliases, title): one page per row of the star schema; the alias spells the key."""
    out = None
    for name, kind, key, title in (("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("part", "part", "p_partkey", "p_name"), ("orders", "order", "o_orderkey", "o_orderkey")):
        alias = F.concat(F.lit(f"{kind} "), F.col(key).cast("string"))
        own = table(spark, sf_dir, name).select(F.concat(F.lit(f"wiki/{kind}/"), F.col(key).cast("string"), F.lit(".md")).alias("path"), F.lit(kind).alias("type"), F.array(alias).alias("aliases"), F.col(title).cast("string").alias("title"))
        out = own if out is None else out.union(own)
    return out


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, label, target): foreign keys as relations between entity paths."""
    page = lambda kind, key: F.concat(F.lit(f"wiki/{kind}/"), F.col(key).cast("string"), F.lit(".md"))
    parts = (("nation", "nation", "n_nationkey", "part-of", "region", "n_regionkey"), ("customer", "customer", "c_custkey", "located-in", "nation", "c_nationkey"), ("supplier", "supplier", "s_suppkey", "located-in", "nation", "s_nationkey"), ("orders", "order", "o_orderkey", "placed-by", "customer", "o_custkey"), ("lineitem", "order", "l_orderkey", "contains", "part", "l_partkey"))
    out = None
    for name, kind, key, label, other, ref in parts:
        own = table(spark, sf_dir, name).select(page(kind, key).alias("page"), F.lit(label).alias("label"), page(other, ref).alias("target"))
        out = own if out is None else out.union(own)
    return out


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as claims of their order's page: category is the return flag, closed when the status is F."""
    core = F.concat_ws(" ", F.lit("part"), F.col("l_partkey").cast("string"), F.lit("from"), F.col("l_suppkey").cast("string"), F.lit("quantity"), F.col("l_quantity").cast("int").cast("string"))
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("wiki/order/"), F.col("l_orderkey").cast("string"), F.lit(".md")).alias("path"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("provenance"), core.alias("core"), (F.col("l_linestatus") == "F").alias("closed"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversation turns as list items: (conv_id, turn, pos, text)."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", F.posexplode(F.split("text", r"[.] ")).alias("pos", "text"))

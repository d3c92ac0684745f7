"""Shard placement through a permutation-filled lookup table.

Each shard walks its own permutation of the slots of a prime-sized table
(start and step come from a digest of its name), and the shards take turns to
claim the next free slot they prefer. The table is balanced to one slot per
shard, and when a shard leaves, few slots of the others move.

The table is bounded by ``size`` (a prime, 4,099 as default), is folded into the
plan as a literal array, and a row's shard is one array access: no shuffle, no
join, whatever key is hot.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first prime over 4,096: with up to 40 shards each has its share within 1 %.
TABLE_SIZE = 4099


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Index of the shard that owns each slot; shards must be distinct, at most ``size``."""
    if not _is_prime(size):
        raise ValueError(f"the table size must be a prime: {size}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct names, at least one and at most one per slot")
    walk = []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        walk.append((int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:], "big") % (size - 1) + 1 if size > 2 else 1))
    owner, turn, claimed = [-1] * size, [0] * len(shards), 0
    while claimed < size:
        for s, (start, step) in enumerate(walk):
            while owner[slot := (start + turn[s] * step) % size] >= 0:
                turn[s] += 1
            owner[slot] = s
            claimed += 1
            if claimed == size:
                break
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 32 bits of its MD5 modulo the size. A null key counts as an empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def with_shard(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """Rows of ``df`` as (key, slot, shard).

    Null keys go to the slot of the empty text, repeated rows each keep their
    row, an empty table gives an empty table. Other columns are not read, so
    their names can't clash.
    """
    names = F.split(F.lit("\n".join(shards[s] for s in fill_table(shards, size))), "\n")
    slots = df.select(F.col(key), slot_of(F.col(key), size).alias("slot"))
    return slots.withColumn("shard", F.element_at(names, F.col("slot") + 1))


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, files_per_shard: int = 8, size: int = TABLE_SIZE) -> None:
    """Write the whole rows under ``path/shard=<name>``; each shard is dealt over several files so that none is one task's work."""
    names = F.split(F.lit("\n".join(shards[s] for s in fill_table(shards, size))), "\n")
    placed = df.withColumn("shard", F.element_at(names, slot_of(F.col(key), size) + 1))
    salt = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, "shard", salt).write.partitionBy("shard").mode("overwrite").parquet(path)

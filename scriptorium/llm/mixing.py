"""Mixing of sources to target weights by Pfair scheduling.

A source's documents form blocks of equal size (characters). With integer target
weights a of total Q, block k (from 1) of a source is released at slot
floor((k-1) Q / a) and due by slot ceil(k Q / a); taking the released block with the
earliest deadline for each slot meets every deadline, so each source's share
differs from its target by less than one block at every slot. The schedule repeats
every Q slots, so one period is scheduled on the driver and a block's slot is
arithmetic. When a source is used up, the others go on with their weights; each such
phase has a period of its own. No document is dropped or repeated.

A document's place in its source is a prefix sum in two levels: sums of (source,
chunk), with chunks by hash of the id, and running sums inside a chunk; a source
with any share of the rows is spread over all chunks.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import fresh

#: Characters per block, documents per chunk, and most chunks.
BLOCK_CHARS, CHUNK_DOCS, CHUNKS = 1 << 18, 512, 100_000


def period(weights: list[int]) -> list[int]:
    """Index of the source that each slot of one period takes; weights are positive integers."""
    total = sum(weights)
    later = [(0, -(-total // a), i, 1) for i, a in enumerate(weights)]  # release, deadline, source, block
    heapq.heapify(later)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(total):
        while later and later[0][0] <= slot:
            _, due, i, k = heapq.heappop(later)
            heapq.heappush(ready, (due, i, k))
        _, i, k = heapq.heappop(ready)
        out.append(i)
        a = weights[i]
        if k < a:
            heapq.heappush(later, (k * total // a, -(-(k + 1) * total // a), i, k + 1))
    return out


def segments(blocks: dict, weights: dict) -> list[tuple]:
    """(source, first block, end block, first slot, blocks a period, period, slots within it) of the whole schedule."""
    left, used, slot, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        names = sorted(left)
        own = [weights[s] for s in names]
        order, total = period(own), sum(own)
        places: dict = {s: [] for s in names}
        for at, i in enumerate(order):
            places[names[i]].append(at)
        whole = min(left[s] // a for s, a in zip(names, own))
        if whole:
            for s, a in zip(names, own):
                out.append((s, used[s], used[s] + whole * a, slot, a, total, places[s]))
                used[s] += whole * a
                left[s] -= whole * a
            slot += whole * total
        else:  # part of a period, up to the first source that ends
            end = min(places[s][left[s] - 1] + 1 for s, a in zip(names, own) if left[s] <= a)
            for s, a in zip(names, own):
                n = sum(p < end for p in places[s])
                if n:
                    out.append((s, used[s], used[s] + n, slot, a, total, places[s]))
                    used[s] += n
                    left[s] -= n
            slot += end
        left = {s: n for s, n in left.items() if n}
    return out


def mix(docs: DataFrame, weights: dict[str, int] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All rows and columns of ``docs`` and _block (of the source), _slot (of the whole order).

    ``weights``: positive integers by source (a source without one counts 1; a null
    source is the source ""); by default the square root of a source's share, in
    thousandths. A null or empty text takes no room; a document longer than a block
    takes as many as it covers and stands in its first. Ties and repeated ids stay in
    any order within their block. An empty table gives an empty table. One row per
    source reaches the driver. If ``docs`` has a column of one of the two names, the
    new one gets underscores before it (``names_of``).
    """
    block_name, slot_name = names_of(docs)
    spark = docs.sparkSession
    if weights and min(weights.values()) < 1:
        raise ValueError("weights must be positive integers")
    size = F.coalesce(F.length(F.col(text_col)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(id_col).alias("id"), size.alias("size"))
    chunks = min(CHUNKS, rows.count() // CHUNK_DOCS + 1)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
    sums = rows.groupBy("source", "chunk").agg(F.sum("size").alias("total"))
    told = {r.source: r.total for r in sums.groupBy("source").agg(F.sum("total").alias("total")).collect()}
    every = sum(told.values()) or 1
    if weights is None:
        weights = {s: max(1, round(1000 * (n / every) ** 0.5)) for s, n in told.items()}
    plan = segments({s: n // block_chars + 1 for s, n in told.items()}, {s: weights.get(s, 1) for s in told})
    before = sums.select(F.col("source").alias("s2"), F.col("chunk").alias("c2"), (F.sum("total").over(Window.partitionBy("source").orderBy("chunk")) - F.col("total")).alias("base"))
    inside = F.sum("size").over(Window.partitionBy("source", "chunk").orderBy("id", "size")) - F.col("size")
    placed = rows.withColumn("inside", inside).join(before, (F.col("source") == F.col("s2")) & (F.col("chunk") == F.col("c2")))
    placed = placed.withColumn("block", F.floor((F.col("inside") + F.col("base")) / F.lit(block_chars)).cast("long"))
    table = spark.createDataFrame(plan, "s3 string, first long, end long, slot0 long, per long, total long, places array<int>")
    found = placed.join(table, (F.col("source") == F.col("s3")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("end")))
    k = F.col("block") - F.col("first")
    slot = F.col("slot0") + F.floor(k / F.col("per")) * F.col("total") + F.element_at("places", (k % F.col("per") + 1).cast("int"))
    return found.select("row.*", F.col("block").alias(block_name), slot.cast("long").alias(slot_name))


def names_of(docs: DataFrame) -> tuple[str, str]:
    """Names of the block and slot columns that ``mix`` adds to a table."""
    return fresh("_block", docs), fresh("_slot", docs)


def ordered(docs: DataFrame, **options) -> DataFrame:
    """The rows and columns of ``docs`` in mixed order (range partitions by slot, sorted inside).

    Nulls, ties, repeated rows, clashing names and empty tables as in ``mix``. A reader of files may deal their rows anew;
    ``mix`` gives the same slots again from the same rows.
    """
    block, slot = names_of(docs)
    return mix(docs, **options).repartitionByRange(slot, block).sortWithinPartitions(slot).drop(block, slot)

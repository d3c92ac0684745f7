"""Which filter removes what, whatever their order: survivors of all orders and Shapley values.

A document's mask says which filters it fails, so counts by part and mask hold all that
orders can tell. A part's removal polynomial, the multilinear extension of "removed by
at least one filter of a set", is f(x) = sum over masks m of n_m (1 - prod over i in m of
(1 - x_i)). At a corner of the cube it counts what that set removes, so the survivors of
an order are evaluations along a path of corners. The integral of its partial derivative
by x_i along the diagonal is filter i's Shapley value, an exact rational; times 5! it's
the filter's removals summed over all orders.

One shuffle of narrow rows by document id (the labels), one by digest with partial sums
in front, one by part and mask; a text that a third of all rows repeat is one row a task
after the partial sums.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import text_or_empty

COUNTS = ["n", "good", "toxic"]


def text_tests(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters A to D: few words, repeated words, capitals, symbols."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters that they fail, filter k of ABCDE as bit k.

    Null texts and parts count as empty ones. A document fails E if any smaller id has
    the same text, whatever its part; rows that repeat an id are counted each, and none of
    them makes the others fail. A null id is neither smaller nor larger than another and
    has no labels. An id with several rows of labels has those that any of them gives.
    """
    text = text_or_empty(text_col)
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_tests(text).values())]
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), sum(bits[1:], bits[0]).alias("mask"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for name, c in (("good", "quality"), ("toxic", "toxic"))))
    sums = lambda *of: [F.sum(c).alias(c) for c in of]
    rows = rows.join(marks, "id", "left").na.fill(0, ["good", "toxic"])
    one = rows.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"), *sums("good", "toxic"))
    # of each text and part: all rows, those of its smallest id, and those without an id
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", *COUNTS))).alias("first")
    without = [F.sum(F.when(F.col("id").isNull(), F.col(c)).otherwise(0)).alias(f"{c}_null") for c in COUNTS]
    texts = one.groupBy("digest", "part", "mask").agg(*sums(*COUNTS), first, *without)
    least = F.min("first.id").over(Window.partitionBy("digest"))
    texts = texts.withColumn("leads", F.coalesce(F.col("first.id") == least, F.lit(False)))
    kept = {c: F.when(F.col("leads"), F.col(f"first.{c}")).otherwise(0) + F.col(f"{c}_null") for c in COUNTS}
    halves = F.array(F.struct("mask", *(kept[c].alias(c) for c in COUNTS)), F.struct((F.col("mask") + 16).alias("mask"), *((F.col(c) - kept[c]).alias(c) for c in COUNTS)))
    return texts.select("part", F.inline(halves)).groupBy("part", "mask").agg(*sums(*COUNTS))


def polynomial(counts: dict[int, int], filters: int) -> dict[tuple[int, ...], int]:
    """Coefficients of the removal polynomial by the variables of their product."""
    out = {}
    for size in range(1, filters + 1):
        for s in combinations(range(filters), size):
            bits = sum(1 << i for i in s)
            out[s] = -((-1) ** size) * sum(n for m, n in counts.items() if m & bits == bits)
    return out


def corner(f: dict[tuple[int, ...], int], on: set[int]) -> int:
    """The polynomial where the variables of ``on`` are 1 and the others 0."""
    return sum(c for s, c in f.items() if on.issuperset(s))


def diagonal(f: dict[tuple[int, ...], int], i: int) -> Fraction:
    """The integral from 0 to 1 of the partial derivative by variable i where all variables are t."""
    degrees = {}
    for s, c in f.items():
        if i in s:
            degrees[len(s) - 1] = degrees.get(len(s) - 1, 0) + c
    return sum((Fraction(c, d + 1) for d, c in degrees.items()), Fraction(0))


def orders(part: str, rows: list[dict], filters: str = "ABCDE"):
    """The steps of all orders of the filters over one part's counts by mask."""
    k = len(filters)
    counts = {c: {r["mask"]: r[c] for r in rows} for c in COUNTS}
    f = {c: polynomial(counts[c], k) for c in COUNTS}
    total, every = sum(counts["n"].values()), set(range(k))
    shapley = {}
    for i in range(k):
        scaled = factorial(k) * diagonal(f["n"], i)
        assert scaled.denominator == 1
        shapley[i] = scaled.numerator
    fails = {i: corner(f["n"], {i}) for i in range(k)}
    alone = {i: corner(f["n"], every) - corner(f["n"], every - {i}) for i in range(k)}
    removed = {c: {b: corner(f[c], {i for i in range(k) if b >> i & 1}) for b in range(1 << k)} for c in COUNTS}
    for order in permutations(range(k)):
        name, before = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            here = {c: removed[c][after] - removed[c][before] for c in COUNTS}
            yield part, name, step, total - removed["n"][after], here["n"], fails[i] - here["n"], alone[i], here["good"], here["toxic"], shapley[i]
            before = after


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Kept, removed and lost documents of each part, order of the filters and step, zeros included.

    What nulls, ties and repeated rows give stands at ``masks``; other columns aren't
    read. A table without rows has no parts and gives no rows; empty labels give no losses.
    """

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in RESULT.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
        for batch in batches:
            for part, rows in zip(batch["part"].to_pylist(), batch["rows"].to_pylist()):
                columns = zip(*orders(part, rows), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    parts = masks(docs, labels, id_col, text_col, part_col).groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("rows"))
    return parts.mapInArrow(run, RESULT)

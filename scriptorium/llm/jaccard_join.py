"""Exact n-gram Jaccard join of documents, with set-relation skipping.

A document's set holds the 64-bit hashes of its distinct word n-grams. Two sets
link when 100 * |A and B| >= percent * |A or B|. The answer is one row per
document with the smallest id it reaches by links, so links inside a group of
copies need not be listed.

1. Equal sets become one (by a 128-bit digest), whatever their number.
2. All n-grams have one global order: first those that aren't frequent, by hash,
   then the frequent ones, rarest first. The frequent ones are the 2^18 with the
   largest counts, which bounds the broadcast; any order gives exact results,
   this one keeps the index lists of shared passages and common lines out of the
   way. Two linked sets share an n-gram among the first n - ceil(p n) + 1 of each.
3. Index lists with one set are dropped. In each list all sets are compared with
   the list's most central one first (the one with the largest share of frequent
   n-grams), a star instead of all pairs.
4. The computed answers are used to skip: sets already in one component need no
   comparison; and by the triangle inequality of the Jaccard distance, two sets
   whose distances from a common centre differ by more than the threshold can't
   link. List blocks whose set sizes or positions rule out the overlap are skipped
   too (a list's blocks are bands of set size; a posting carries the number of
   n-grams from its position on).
5. A set has a parity sketch of about one bit an n-gram. Two sketches differ in no
   more bits than the sets do in n-grams, so pairs that differ in too many bits are
   out without a look at their texts. What is left is compared exactly.

Texts of sets that stand in a list are written once, bucketed by id: they are
shuffled once, and later joins move only pairs. Comparisons are dealt by (centre,
salt) with at most a few hundred sets a group, so no group grows with the number
of copies. Joins with tables that grow with the documents are merge joins at every
size. Intermediate tables are deleted before the result is returned, but for those
that it reads.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import bucketed, discard, fresh, shared_dir, slices, written
from scriptorium.llm.components import components

#: Frequent n-grams that are broadcast, and sets compared in one group.
FREQUENT, GROUP = 1 << 18, 256
#: Characters of text that are counted together when looking for frequent n-grams.
CHUNK_CHARS = 2_000_000
#: Most bits of a sketch. Sets beyond have a weaker filter, not another result.
SKETCH_BITS = 1 << 16


def shingles(text: str | None, width: int = 4):
    """Sorted hashes of the distinct word n-grams; a shorter text is one n-gram, one without words has none."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()
    if len(words) < width:
        return np.array([xxh3_64_intdigest(b" ".join(words), len(words))] if words else [], np.uint64)
    code = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[k : k + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def sketch(s) -> bytes:
    """Parity bits of a set: bit b tells whether an odd number of its hashes falls to b. Bits are a power of two, about one a hash."""
    import numpy as np

    bits = min(SKETCH_BITS, max(64, 1 << (len(s) - 1).bit_length())) if len(s) else 64
    at = ((s >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the shorter: at most the size of the sets' symmetric difference."""
    if len(a) < len(b):
        a, b = b, a
    x, size = int.from_bytes(a), 8 * len(a)
    while size > 8 * len(b):
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    return (x ^ int.from_bytes(b)).bit_count()


def most_difference(n: int, percent: int) -> int:
    """Largest symmetric difference of two linked sets whose sizes sum to n."""
    return n - 2 * -(-percent * n // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    """How many of the first n-grams of a set of n must be looked at."""
    return n - -(-percent * n // 100) + 1


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, n, digest, sketch) of each row and (gram, count) of the n-grams that repeat in a chunk."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        names = ["id", "n", "digest", "sketch", "gram", "kind"]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in slices(texts, CHUNK_CHARS):
                own = [shingles(t, width) for t in texts[i:j]]
                m = j - i
                yield pa.RecordBatch.from_arrays([ids.slice(i, m), pa.array([len(s) for s in own], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in own]), pa.array([sketch(s) for s in own]), pa.nulls(m, pa.int64()), pa.array(np.zeros(m, np.int32))], names)
                grams, counts = np.unique(np.concatenate(own), return_counts=True)
                grams, counts = grams[counts > 1], counts[counts > 1]
                m = len(grams)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(counts.astype(np.int64)), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(grams.view(np.int64)), pa.array(np.ones(m, np.int32))], names)

    schema = "id long, n long, digest binary, sketch binary, gram long, kind int"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col))
    rows.mapInArrow(run, schema).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    both = docs.sparkSession.read.schema(schema).parquet(path)
    return both.filter("kind = 0").select("id", "n", "digest", "sketch"), both.filter("kind = 1").select("gram", F.col("n").alias("count"))


def _postings(docs: DataFrame, firsts: DataFrame, grams: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(gram, id, n, rest, central) of the first n-grams of each distinct set; rest: n-grams from this position on."""
    import numpy as np

    top = grams.groupBy("gram").agg(F.sum("count").alias("c")).orderBy(F.desc("c"), "gram").limit(FREQUENT).toPandas()
    order = np.lexsort((top["gram"].to_numpy(), top["c"].to_numpy()))
    frequent = top["gram"].to_numpy()[order].view(np.uint64)  # rarest first
    by_gram = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[by_gram], by_gram.astype(np.int64)))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        keys, ranks = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices(texts, CHUNK_CHARS):
                sizes, central, firsts = [], [], []
                for t in texts[i:j]:
                    s = shingles(t, width)
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                        hit = keys[at] == s
                        late = s[hit][np.argsort(ranks[at[hit]])]
                        s, share = np.concatenate([s[~hit], late]), len(late) / max(1, len(s))
                    else:
                        share = 0.0
                    sizes.append(len(s))
                    central.append(round(share, 4))
                    firsts.append(s[: prefix_size(len(s), percent)].view(np.int64) if len(s) else s.view(np.int64))
                offsets = np.cumsum([0, *map(len, firsts)])
                lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(np.concatenate(firsts))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(central, pa.float64()), lists], ["id", "n", "central", "grams"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, n long, central double, grams array<long>")
    return rows.join(firsts.select("id").hint("merge"), "id", "left_semi").select("id", "n", "central", F.posexplode("grams").alias("pos", "gram")).select("gram", "id", "n", "central", (F.col("n") - F.col("pos")).alias("rest"))


def _possible(pairs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """The pairs (p, m) whose sketches don't rule a link out."""

    def side(c: str) -> DataFrame:
        return firsts.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())
            sketches = zip(batch.column(3).to_pylist(), batch.column(5).to_pylist())
            keep = [sketch_distance(*ab) <= most_difference(sum(sizes), percent) for sizes, ab in zip(n, sketches)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(side("p").hint("merge"), "p").join(side("m").hint("merge"), "m")
    return joined.select("p", "m", "n_p", "sketch_p", "n_m", "sketch_m").mapInArrow(run, "p long, m long").distinct()


def _compare(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(p, m, both, n_p, n_m) of distinct pairs (p, m): size of the intersection and of the sets, for each text of either id."""
    salted = pairs.join(pairs.groupBy("p").agg(F.count("*").alias("_n")), "p")
    salted = salted.select("p", "m", F.pmod(F.xxhash64("m"), F.ceil(F.col("_n") / GROUP).cast("long")).cast("int").alias("salt"))
    members = salted.join(texts.hint("merge"), F.col("m") == F.col("id")).select("p", "salt", "m", "text")
    centres = salted.select("p", "salt").distinct().join(texts.hint("merge"), F.col("p") == F.col("id")).select("p", "salt", F.lit(None).cast("long").alias("m"), "text")
    dealt = members.unionByName(centres).repartition("p", "salt").sortWithinPartitions("p", "salt", F.col("m").asc_nulls_first())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["p", "m", "both", "n_p", "n_m"]
        now, centres = None, []
        for batch in batches:
            rows: list[tuple] = []
            for p, salt, m, text in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingles(text, width)
                if m is None:
                    now, centres = (p, salt), [*(centres if now == (p, salt) else []), s]
                elif (p, salt) == now:
                    rows += [(p, m, len(np.intersect1d(c, s, assume_unique=True)), len(c), len(s)) for c in centres]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return dealt.mapInArrow(run, "p long, m long, both long, n_p long, n_m long")


def _linked(percent: int):
    return F.expr(f"100 * both >= {percent} * (n_p + n_m - both)")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: id (long), n_shingles, component_id.

    Nulls, empty texts and texts without words have an empty set and link with
    nothing. A pair exactly at the threshold links. Rows that repeat an id give
    a row each and are one document (their sets link through the id); a null id
    has no component. An empty table gives an empty table; other columns are not
    read.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/jaccard-{uuid.uuid4().hex}"
    rows, grams = _sets(docs, id_col, text_col, width, path)
    known, many_rows = rows.filter("n > 0 and id is not null"), rows.count()
    firsts = written(known.groupBy("digest", "n", "sketch").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "jaccard-firsts", rows=many_rows)
    copies = known.join(firsts.filter("copies > 1").select("digest", F.col("id").alias("v")), "digest").select(F.col("id").alias("u"), "v").filter("u <> v")

    postings = _postings(docs, firsts, grams, id_col, text_col, width, percent)
    # index lists in bands of set size, and in bands shifted by half. A band is more than twice as wide, in logarithms, as
    # the sizes of linked sets can differ, so these share one of either. Rows that are alone in both bands have no
    # partner; the others get the bands' most central sets (ties: the smallest id).
    scale = f"ln(n) / ({2.02 * math.log(100 / percent)})"
    per_gram = postings.repartition("gram").selectExpr("*", f"cast(floor({scale}) as int) as band", f"cast(floor({scale} + 0.5) as int) as half")
    top, many = "max(struct(central, -id as neg, n, rest)) over (partition by gram, {0}) as _{0}", "count(*) over (partition by gram, {0}) as _n_{0}"
    counted = per_gram.selectExpr("gram", "id", "n", "rest", "band", *(x.format(b) for b in ("band", "half") for x in (top, many)))
    lists = written(counted.filter("_n_band > 1 or _n_half > 1").drop("_n_band", "_n_half"), "jaccard-lists")
    active = lists.select("id").distinct()
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = bucketed(own.join(active.hint("merge"), "id", "left_semi").dropDuplicates(["id", "text"]), "id", "jaccard_texts")

    fits = "100 * least(n, t.n) >= {0} * greatest(n, t.n) and {0} * (n + t.n) <= (100 + {0}) * least(rest, t.rest)".format(percent)
    stars = lists.select("id", "n", "rest", F.explode(F.array("_band", "_half")).alias("t")).filter("id <> -t.neg").filter(fits)
    stars = written(_possible(stars.select((-F.col("t.neg")).alias("p"), F.col("id").alias("m")).distinct(), firsts, percent), "jaccard-stars", rows=many_rows)
    first = written(_compare(stars, texts, width), "jaccard-first")
    linked = first.filter(_linked(percent)).select(F.col("p").alias("u"), F.col("m").alias("v"))
    labels = components(linked, "jaccard-labels", many_rows)

    # what is left: pairs of a list in two components, not compared yet and not ruled out. A pair of ids with several
    # texts has several distances, which rule nothing out
    distance = F.expr("1 - both / (n_p + n_m - both)")
    once = first.groupBy("m", "p").agg(F.count("*").alias("_c"), F.min(distance).alias("d")).filter("_c = 1")
    known_from = once.groupBy(F.col("m").alias("_m")).agg(F.collect_list(F.struct("p", "d")).alias("pds"))
    ends = active.join(labels, F.col("id") == F.col("u"), "left").select("id", F.coalesce("v", "id").alias("label"))
    mixed = lists.select("gram", "id", "n", "rest", "band").join(ends, "id")
    open_lists = mixed.groupBy("gram").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).filter("_a <> _b").select("gram")
    mixed = mixed.join(open_lists, "gram")
    left = mixed.select("gram", *(F.col(c).alias(f"{c}_1") for c in ("id", "n", "rest", "label", "band")))
    right = mixed.select("gram", *(F.col(c).alias(f"{c}_2") for c in ("id", "n", "rest", "label", "band")))
    need = F.expr(f"{percent} * (n_1 + n_2) <= (100 + {percent}) * least(rest_1, rest_2)")
    size = F.expr(f"100 * least(n_1, n_2) >= {percent} * greatest(n_1, n_2)")
    near = left.join(right, "gram").filter("id_1 < id_2 and label_1 <> label_2 and abs(band_1 - band_2) <= 1").filter(size & need).select(F.col("id_1").alias("p"), F.col("id_2").alias("m")).distinct()
    done = first.select(F.least("p", "m").alias("p"), F.greatest("p", "m").alias("m"))
    near = near.join(done, ["p", "m"], "left_anti")
    a = known_from.select(F.col("_m").alias("p"), F.col("pds").alias("a"))
    b = known_from.select(F.col("_m").alias("m"), F.col("pds").alias("b"))
    near = near.join(a, "p", "left").join(b, "m", "left")
    far = F.expr(f"exists(coalesce(a, array()), x -> exists(coalesce(b, array()), y -> x.p = y.p and abs(x.d - y.d) > 1 - {percent} / 100D + 1e-9))")
    rest = written(_possible(near.filter(~far).select("p", "m"), firsts, percent), "jaccard-rest", rows=many_rows)
    second = written(_compare(rest, texts, width), "jaccard-second")
    links = labels.select("u", "v").union(second.filter(_linked(percent)).select(F.col("p").alias("u"), F.col("m").alias("v"))).union(copies)
    final = components(links, "jaccard-components", many_rows)
    discard(firsts, lists, texts, stars, first, labels, rest, second)
    out = rows.join(final, F.col("id") == F.col("u"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("v", "id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class, with all their columns.

    Rows with a null id stay, as do documents without words and all rows of an id that repeats. An empty table gives an
    empty table. Names of other columns don't matter.
    """
    name = fresh("kept", docs)
    kept = classes(docs, id_col, text_col, width, percent).filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    matched = docs.join(kept.hint("merge"), F.col(id_col).cast("long") == F.col(name), "left_semi")
    return matched.unionByName(docs.filter(F.col(id_col).isNull()))

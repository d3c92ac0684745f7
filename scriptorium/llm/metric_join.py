"""Exact cosine join of vectors inside their labels, by pivots.

Normalized vectors of one label and length lie in the cell of their nearest pivot.
With r the distance of two unit vectors at the threshold, a vector x can have
partners in the cell of pivot i only if d(x, i)^2 - d(x, home)^2 <= 2 r d(i, home), with
room for rounding, so it is replicated to those cells and no other (triangle inequality), and cells
join independently. A cell is cut into blocks of at most about a thousand home
vectors; a block holds its homes and streams the cell's candidates, so memory is
bounded whatever the label's share. Equal vectors are one beforehand. A block
returns link counts of its homes and an edge a vector that has the components of its links,
by labels that spread over the block's matrix, never all pairs; components are joined over
all blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import written
from scriptorium.llm.components import components

#: Vectors per pivot aimed at, most pivots in all (they are broadcast), homes per block.
CELL, PIVOTS, BLOCK = 2000, 4096, 1024


def _unit(rows):
    import numpy as np

    x = np.array(rows, np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _homes_and_reach(x, p, r: float):
    """Nearest pivot of each unit vector, and the pivots in whose cells vectors within r of it can be at home."""
    import numpy as np

    # above the rounding error of a squared distance; pivots can be equal but for rounding, so nothing is divided by their distance
    slack = 16 * (p.shape[1] + 8) * np.finfo(np.float64).eps
    rows, d2 = np.arange(len(x)), np.maximum(0, 2 - 2 * x @ p.T)
    between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T) + slack)
    home = d2.argmin(1)
    reach = d2 - d2[rows, home][:, None] <= 2 * between[home] * (r + 1e-9) + slack
    reach[rows, home] = True
    return home, reach


def _spread(labels, hit):
    """(labels of the homes, labels of the columns) after each column that hits joins its homes: the smallest home that each is linked with.

    ``labels``: for each home one of its component, the smallest. A column's label is the number of homes where it hits none.
    """
    import numpy as np

    n, now = len(labels), labels
    while True:
        columns = np.where(hit, now[:, None], n).min(0, initial=n)
        rows = np.minimum(now, np.where(hit, columns[None, :], n).min(1, initial=n))
        least = np.full(n, n)
        np.minimum.at(least, now, rows)  # what one home of a component learns, all do
        after = least[now]
        after = np.minimum(after, after[after])
        if (after == now).all():
            return now, columns
        now = after


def _block_join(homes, candidates, threshold: float):
    """homes: (ids, copies, matrix); candidates: iterator of the same. Returns (weights of links per home, edges).

    The edges, one a candidate and one a home at most, have the components of the links.
    """
    import math

    import numpy as np

    ids, copies, x = homes
    links, labels, edges = np.asarray(copies, np.int64) - 1, np.arange(len(ids)), []
    mine = np.asarray(ids)
    for own, many, y in candidates:
        cos = x @ y.T
        near = np.abs(cos - threshold) < 1e-9
        for a, b in zip(*np.nonzero(near)):
            cos[a, b] = math.fsum((x[a] * y[b]).tolist())
        hit = cos >= threshold
        other = np.asarray(own)
        hit &= mine[:, None] != other[None, :]
        links += hit @ np.asarray(many, np.int64)
        labels, columns = _spread(labels, hit)
        linked = np.flatnonzero(columns < len(ids))
        edges.append((mine[columns[linked]], other[linked]))
    away = np.flatnonzero(labels != np.arange(len(ids)))
    edges.append((mine[labels[away]], mine[away]))
    u, v = (np.concatenate(side) for side in zip(*edges, strict=True))
    return links, list(zip(u.tolist(), v.tolist(), strict=True))


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and
    those without a label, link with nothing; so do vectors of different lengths. A
    pair exactly at the threshold links. Repeated rows are vectors of their own; a
    null id has no component. An empty table gives an empty table; other columns
    are not read. ``id_col`` is an integer; only the pivots reach the driver.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = rows.filter("id is not null and label is not null and size(v) > 0").filter(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    firsts = written(good.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("dim", F.size("v")), "metric-firsts")
    same = good.join(firsts.filter("copies > 1").select("label", "v", F.col("id").alias("first")), ["label", "v"])

    large = firsts.groupBy("label", "dim").agg(F.count("*").alias("n")).filter(F.col("n") >= 2 * CELL).orderBy(F.desc("n"), "label", "dim").limit(PIVOTS).collect()
    total = sum(r.n for r in large)
    share = [(r.label, r.dim, p := int(max(2, min(r.n // CELL, PIVOTS * r.n // max(total, 1)))), 8.0 * p / r.n) for r in large]
    pivots: dict = {}
    if share:
        label_type = firsts.schema["label"].dataType.simpleString()
        wanted = spark.createDataFrame(share, f"label {label_type}, dim int, p int, part double")
        # the p vectors of a label whose hashes are smallest, out of about 8 p whose hashes are below a bound
        thin = firsts.join(F.broadcast(wanted), ["label", "dim"]).filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("part") * (1 << 30))
        own = F.array_sort(F.collect_list(F.struct(F.xxhash64("id").alias("h"), "v"))).alias("own")
        for r in thin.groupBy("label", "dim", "p").agg(own).collect():
            pivots[r.label, r.dim] = _unit([x.v for x in r.own[: r.p]])
    shared = spark.sparkContext.broadcast(pivots)
    r = (2 - 2 * threshold) ** 0.5

    def deal(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            labels, dims = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            flat, offsets = batch.column(2).flatten().to_numpy(), batch.column(2).offsets.to_numpy()
            cells, targets = np.zeros(len(labels), np.int32), [[0]] * len(labels)
            groups: dict = {}
            for k, key in enumerate(zip(labels, dims)):
                groups.setdefault(key, []).append(k)
            base = offsets[0]
            for key, own in groups.items():
                p = shared.value.get(key)
                if p is None:
                    continue
                x = _unit([flat[offsets[k] - base : offsets[k + 1] - base] for k in own])
                home, reach = _homes_and_reach(x, p, r)
                for k, h, t in zip(own, home, reach):
                    cells[k], targets[k] = h, np.flatnonzero(t).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(targets, pa.list_(pa.int32()))], [*batch.schema.names, "cell", "targets"])

    kinds = f"id long, label {firsts.schema['label'].dataType.simpleString()}, v array<double>, dim int, copies long"
    dealt = firsts.select("id", "label", "v", "dim", "copies").mapInArrow(deal, f"{kinds}, cell int, targets array<int>")
    dealt = written(dealt, "metric-cells")
    blocks = dealt.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    homes = dealt.join(blocks, ["label", "dim", "cell"]).select("label", "dim", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "copies", "v")
    seen = dealt.drop("cell").withColumn("cell", F.explode("targets")).join(blocks, ["label", "dim", "cell"])
    seen = seen.select("label", "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "id", "copies", "v")
    keys = ["label", "dim", "cell", "block"]
    streams = homes.union(seen).repartition(*keys).sortWithinPartitions(*keys, "kind")

    def joined(batches):
        import itertools

        import pyarrow as pa

        names = ["id", "links", "other"]

        def rows_of():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def parts(rows, size=2048):
            while some := list(itertools.islice(rows, size)):
                yield [x[5] for x in some], [x[6] for x in some], _unit([x[7] for x in some])

        for _, group in itertools.groupby(rows_of(), key=lambda x: x[:4]):
            streams = itertools.groupby(group, key=lambda x: x[4])
            kind, own = next(streams)
            if kind != 0:
                continue
            own = list(own)
            homes = [x[5] for x in own], [x[6] for x in own], _unit([x[7] for x in own])
            links, edges = _block_join(homes, (p for _, rest in streams for p in parts(rest)), threshold)
            n, m = len(own), len(edges)
            yield pa.RecordBatch.from_arrays([pa.array(homes[0] + [a for a, _ in edges], pa.int64()), pa.array(links.tolist() + [None] * m, pa.int64()), pa.array([None] * n + [b for _, b in edges], pa.int64())], names)

    found = written(streams.mapInArrow(joined, "id long, links long, other long"), "metric-links")
    edges = found.filter("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v"))
    classes = components(edges.union(same.select(F.col("id").alias("u"), F.col("first").alias("v"))), "metric-components")
    counts = found.filter("other is null").select(F.col("id").alias("first"), "links")
    others = same.filter("id <> first").select("id", "first").join(counts, "first").select("id", "links")
    n_links = counts.select(F.col("first").alias("id"), "links").union(others).groupBy("id").agg(F.max("links").alias("links"))
    out = rows.select("id").join(n_links, "id", "left").join(classes, F.col("id") == F.col("u"), "left")
    component = F.coalesce("v", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))

import itertools
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest

from scriptorium.llm import common, components, jaccard_join, metric_join


def reach(nodes, edges):
    up = {n: n for n in nodes}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = reach({n for e in edges for n in e}, edges)
    assert got == {n: m for n, m in want.items() if n != m}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def gram_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def brute(rows, width, percent):
    sets = [(d, gram_set(t, width)) for d, t in rows]
    edges = [(a, b) for (a, s), (b, t) in itertools.combinations(sets, 2) if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t)]
    comp = reach({d for d, _ in sets if d is not None}, edges)
    return sorted(((d, len(s), comp.get(d)) for d, s in sets), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopq") + str(rng.randrange(30))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 8, 40, 120]))]
        if rng.random() < 0.5:
            base += passage
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    chain = [word() for _ in range(60)]  # each a near copy of the one before only
    for _ in range(12):
        chain = chain[2:] + [word(), word()]
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    return [(k * 3, t) for k, t in enumerate(texts)]


def test_jaccard_of_sets_whose_sizes_differ_most(spark):
    rows = []
    for n in range(4, 60):  # a text and its prefix at or just beyond the threshold, for many sizes
        words = [f"w{n}x{k}" for k in range(n + 3)]
        rows += [(n * 10, " ".join(words)), (n * 10 + 1, " ".join(words[: -(-85 * n // 100) + 3])), (n * 10 + 2, " ".join(words[: 85 * n // 100 + 2]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard_join.classes(docs).collect()), key=str) == brute(rows, 4, 85)


@pytest.mark.parametrize("seed,width,percent", [(1, 4, 85), (2, 5, 80)])
def test_jaccard_classes(spark, odd_docs, seed, width, percent):
    rows = corpus(seed) + [(10_000 + (r.doc_id or 0) if r.doc_id is not None else None, r.text) for r in odd_docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_join.classes(docs, width=width, percent=percent).collect()), key=str)
    assert got == brute(rows, width, percent)


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n, m, both = rng.integers(0, 400, 3)
        pool = rng.integers(0, 1 << 63, n + m + both, dtype=np.uint64)
        a, b = np.unique(pool[: n + both]), np.unique(pool[n:])
        d = jaccard_join.sketch_distance(jaccard_join.sketch(a), jaccard_join.sketch(b))
        assert d <= len(np.setxor1d(a, b)) and (len(np.setxor1d(a, b)) or d == 0)
    for percent in (80, 85, 100):
        for n, m in itertools.product(range(1, 40), repeat=2):
            linked = [n + m - 2 * k for k in range(min(n, m) + 1) if 100 * k >= percent * (n + m - k)]
            assert not linked or max(linked) <= jaccard_join.most_difference(n + m, percent)


def test_jaccard_of_an_id_with_several_texts(spark):
    rng = random.Random(4)
    texts = [" ".join(f"{rng.randrange(10**6)}" for _ in range(40)) for _ in range(6)]
    near = [t.rpartition(" ")[0] + " other" for t in texts]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, near[0]), (3, near[1]), (4, texts[2]), (5, texts[3]), (4, texts[3]), (6, near[2]), (7, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.classes(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7}


def test_jaccard_leaves_nothing_behind_but_what_the_result_reads(spark):
    docs = spark.createDataFrame(corpus(3), "doc_id long, text string").withColumnsRenamed({"doc_id": "u", "text": "_kept"})
    shared = Path(common.shared_dir(spark).removeprefix("file:"))
    before, tables = {p.name for p in shared.iterdir()}, spark.catalog.listTables()
    out = jaccard_join.keep_first(docs, "u", "_kept")
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    left = {p.name for p in shared.iterdir()} - before  # the sets and the components
    assert len(left) == 2 and spark.catalog.listTables() == tables


def test_jaccard_keep_first(spark, odd_docs):
    kept = jaccard_join.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in odd_docs.collect())
    assert jaccard_join.keep_first(odd_docs.limit(0)).count() == 0


def cosine(a, b):
    return math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a)) / math.sqrt(math.fsum(x * x for x in b))


def test_metric_join(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL", 20)
    monkeypatch.setattr(metric_join, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = []
    for label in (1, 2):
        centres = rng.normal(size=(12, 8))
        for _ in range(110):
            v = centres[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.05, 0.3, 1.0])
            rows.append(([float(np.float32(x)) for x in v], label))
    rows += [rows[5]] * 6 + [([1.0, 0.0], 1), ([2.0, 0.0], 1), ([2.0, 0.0], 2), ([2.0, 0.0], None), ([0.0] * 8, 1), (None, 1), ([], 1), ([1.0, None], 1), ([float("nan"), 1.0], 1), ([float("inf"), 1.0], 1)]
    table = spark.createDataFrame([(k, v, label, "x") for k, (v, label) in enumerate(rows)], "vec_id long, embedding array<float>, label int, kept string")
    good = {k for k, (v, label) in enumerate(rows) if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    edges = [(a, b) for a, b in itertools.combinations(sorted(good), 2) if rows[a][1] == rows[b][1] and len(rows[a][0]) == len(rows[b][0]) and cosine(rows[a][0], rows[b][0]) >= 0.93]
    comp = reach(range(len(rows)), edges)
    links = dict.fromkeys(range(len(rows)), 0)
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metric_join.link(table).collect()}
    assert got == {k: (links[k], comp[k], comp[k] == k) for k in range(len(rows))}
    assert metric_join.link(table.limit(0)).count() == 0


def test_pivots_that_are_scaled_copies_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL", 50)
    rng = np.random.default_rng(3)
    base, n = rng.normal(size=16), 1200
    x = base * rng.uniform(0.5, 2, n)[:, None]
    x[::2] = x[::2].astype(np.float32)
    x[1::5] += rng.normal(size=(n // 5, 16)) * 0.3
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cos = unit @ unit.T
    assert np.abs(cos - 0.93).min() > 1e-9
    rows = [(k, "a", v) for k, v in enumerate(x.tolist())]
    got = {r.vec_id: r.n_links for r in metric_join.link(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    assert [got[k] for k in range(n)] == ((cos >= 0.93).sum(1) - 1).tolist()


def test_block_edges_have_the_components_of_all_links():
    import numpy as np

    from scriptorium.llm import metric_join

    rng = np.random.default_rng(4)
    for case in range(60):
        n, m = rng.integers(1, 30), rng.integers(0, 60)
        x = metric_join._unit(rng.normal(size=(n, 2)))
        y = metric_join._unit(np.concatenate([x, rng.normal(size=(m, 2))]))
        ids, own = np.arange(n).tolist(), np.arange(n + m).tolist()
        chunks = [(own[k : k + 7], [1] * len(own[k : k + 7]), y[k : k + 7]) for k in range(0, n + m, 7)]
        links, edges = metric_join._block_join((ids, [1] * n, x), iter(chunks), 0.9 + 0.0999 * (case % 3) / 2)
        hit = (x @ y.T >= 0.9 + 0.0999 * (case % 3) / 2) & (np.arange(n)[:, None] != np.arange(n + m)[None, :])
        assert links.tolist() == hit.sum(1).tolist() and len(edges) <= 2 * n + m

        def classes(pairs, total=n + m):
            label = list(range(total))
            while True:
                before = list(label)
                for a, b in pairs:
                    label[a] = label[b] = min(label[a], label[b])
                if label == before:
                    return label

        assert classes(edges) == classes(list(zip(*(c.tolist() for c in np.nonzero(hit)), strict=True)))


def test_a_block_where_all_link_takes_no_step_a_pair():
    import time

    import numpy as np

    from scriptorium.llm import metric_join

    x = metric_join._unit(1 + 1e-3 * np.random.default_rng(0).normal(size=(3072, 16)))
    began = time.time()
    links, edges = metric_join._block_join((list(range(1024)), [1] * 1024, x[:1024]), [(list(range(1024, 3072)), [1] * 2048, x[1024:])], 0.93)
    assert links.tolist() == [2048] * 1024 and len(edges) == 2048 + 1023 and time.time() - began < 1.5

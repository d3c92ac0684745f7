import itertools
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from scriptorium.llm import jaccard_join, line_quality, mixing, packing, pii
from scriptorium.llm.tokens import PieceEncoder


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12))
def test_period_stays_within_a_block(weights):
    total, done = sum(weights), [0] * len(weights)
    for t, i in enumerate(mixing.period(weights), 1):
        done[i] += 1
        assert all(abs(d - Fraction(a * t, total)) < 1 for d, a in zip(done, weights))
    assert done == weights


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 60), min_size=1), st.integers(1, 9))
def test_segments_place_every_block_once(blocks, seed):
    weights = {s: 1 + (ord(s) * seed) % 7 for s in blocks}
    slots = {}
    for s, first, end, slot0, per, total, places in mixing.segments(blocks, weights):
        for k in range(first, end):
            slots[s, k] = slot0 + (k - first) // per * total + places[(k - first) % per]
    assert sorted(slots) == sorted((s, k) for s, n in blocks.items() for k in range(n))
    assert sorted(slots.values()) == list(range(sum(blocks.values())))
    # until the first source ends, every prefix is within one block of the targets
    live = {s: n for s, n in blocks.items() if n}
    total, done = sum(weights[s] for s in live), dict.fromkeys(live, 0)
    for t, (s, _) in enumerate(sorted(slots, key=slots.get), 1):
        done[s] += 1
        if any(done[x] == live[x] for x in live):
            break
        assert all(abs(done[x] - Fraction(weights[x] * t, total)) < 1 for x in live)


def test_mix(spark, odd_docs):
    rows = [(1000 + k, "t" * (k % 50), f"s{k % 7 % 3}", k) for k in range(400)] + [(5000, "x", None, 1)]
    docs = odd_docs.union(spark.createDataFrame(rows, odd_docs.schema))
    made = mixing.mix(docs, {"s0": 3, "s1": 1}, block_chars=100).collect()
    assert len(made) == docs.count()
    assert len({(r.source or "", r._block) for r in made}) == len({r._slot for r in made})
    sizes: dict = {}
    for r in made:
        sizes.setdefault((r.source, r._block), []).append(len(r.text or ""))
    assert all(sum(v) < 100 + max(v) for v in sizes.values())
    out = mixing.ordered(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    good = [" ".join(f"w{(k * 7 + i * i) % 211} is" for i in range(40)).capitalize() + "." for k in range(12)]
    texts = good + [good[0], good[1] + " End.", "Buy | now | " * 30, "short", None, good[2] + " Mail a.b@mail.example.com today."]
    rows = [(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    made = corpus_pipeline.run(spark, str(tmp_path)).collect()

    weights, trans = line_quality.trained()
    kept = [(d, t) for d, t, *_ in rows if line_quality.judge(t, weights, trans.tolist())[6]]
    first: list = []
    for d, t in kept:  # groups here are stars around their first text
        s = set(jaccard_join.shingles(t, 5).tolist())
        if not any(100 * len(s & x) >= 80 * len(s | x) for _, _, x in first):
            first.append((d, t, s))
    code, p = PieceEncoder(packing.VOCABULARY), pii.trained()
    want = {}
    for d, t, _ in first:
        (base, added), = pii.find([t], p)
        out, at = "", 0
        for a, kind, b in sorted(base + added):
            out, at = out + t[at:a] + f"[{kind}]", b
        want[d] = len(code.encode(out + t[at:])) // 4 + 1
    got: dict = {}
    for r in made:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and 10 <= len(want) <= 13
    assert len(corpus_pipeline.STAGES) == 5 and set(itertools.chain(map(type, corpus_pipeline.STAGES))) == {tuple}


def test_pipeline_of_odd_tables(spark, odd_docs, tmp_path):
    """Empty tables, nulls, repeated rows, very long texts and clashing names pass every stage but the last with their columns."""
    clash = odd_docs.selectExpr("*", "1 as _slot", "2 as _block", "'x' as _kept", "3 as id", "4 as lang", "5L as n_chars")
    for docs in (clash, clash.limit(0)):
        got = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, got, "")
            assert got.columns == docs.columns, name
            got.write.mode("overwrite").parquet(str(tmp_path / name.replace(" ", "-")))
            got = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        last = corpus_pipeline.STAGES[-1][1](spark, got, "").collect()
        assert {r.doc_id for r in last} == {r.doc_id for r in got.collect()}
    assert corpus_pipeline.mixed(spark, clash, "").count() == clash.count() and corpus_pipeline.near_duplicates(spark, clash, "").columns == clash.columns


def test_sequences_follow_the_slots(spark):
    rows = [(k, f"word{k} " * 2500, f"s{k % 2}") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slot = {r.doc_id: r._slot for r in mixing.mix(docs).collect()}
    names = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"
    before = [spark.conf.get(k) for k in names]
    for k, v in zip(names, ("false", "4")):
        spark.conf.set(k, v)
    try:
        again = corpus_pipeline.mixed(spark, docs, "").orderBy("doc_id").repartition(3)  # as files that are read in another order
        made = corpus_pipeline.packed(spark, again, "").collect()
    finally:
        for k, v in zip(names, before):
            spark.conf.set(k, v)
    parts: dict = {}
    for r in made:
        parts.setdefault(r.sequence_id >> 40, []).append(slot[r.doc_id])
    ranges = [(min(v), max(v)) for _, v in sorted(parts.items())]
    assert {r.doc_id for r in made} == set(slot) and len(ranges) > 1
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(ranges))


def _slots_by_simulation(sizes: dict[str, list[int]], weights: dict[str, int], block: int) -> dict[str, list[tuple[int, int]]]:
    """(block, slot) of every document by taking slot after slot: of the released blocks the one due first. A period that all sources fill is taken whole, else a phase ends with its first source."""
    ends = {s: sum(v) // block + 1 for s, v in sizes.items()}
    slot_of, done, t = {}, dict.fromkeys(sizes, 0), 0
    while live := sorted(s for s in sizes if done[s] < ends[s]):
        total, began = sum(weights[s] for s in live), t
        taken = dict.fromkeys(live, 0)
        whole = all(ends[s] - done[s] >= weights[s] for s in live)
        while t - began < total if whole else all(done[s] < ends[s] for s in live):
            ready = [(-(-(taken[s] + 1) * total // weights[s]), s) for s in live if taken[s] * total // weights[s] <= t - began]
            _, s = min(ready)
            slot_of[s, done[s]] = t
            taken[s], done[s], t = taken[s] + 1, done[s] + 1, t + 1
    out = {}
    for s, v in sizes.items():
        at = 0
        for n in v:
            out.setdefault(s, []).append((at // block, slot_of[s, at // block]))
            at += n
    return out


def test_slots_of_mix_by_simulation(spark):
    from pyspark.sql import functions as F

    rows = [(k, "t" * (k * 37 % 90), f"s{(k * k) % 11 % 4}") for k in range(700)] + [(900, "x" * 1000, "s1"), (901, None, "s2"), (902, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in ({"s0": 5, "s1": 2, "s2": 1}, {"s3": 7}):
        made = mixing.mix(docs, weights, block_chars=150).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(docs.count() // mixing.CHUNK_DOCS + 1))).collect()
        own: dict = {}
        for r in sorted(made, key=lambda r: (r.chunk, r.doc_id)):
            own.setdefault(r.source or "", []).append((len(r.text or ""), r._block, r._slot))
        want = _slots_by_simulation({s: [x[0] for x in v] for s, v in own.items()}, {s: weights.get(s, 1) for s in own}, 150)
        assert {s: [x[1:] for x in v] for s, v in own.items()} == want

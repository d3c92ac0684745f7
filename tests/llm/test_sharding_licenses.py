import re
from collections import Counter

import pytest

from scriptorium.llm import licenses, sharding


def test_table_is_balanced_and_stable():
    names = [f"s{k}" for k in range(10)]
    full, less = sharding.fill_table(names, 1009), sharding.fill_table(names[:-1], 1009)
    assert max(Counter(full).values()) - min(Counter(full).values()) <= 1
    moved = sum(a != b for a, b in zip(full, less) if a != 9)
    assert moved < 0.15 * 1009
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 8)


def test_placement(spark, odd_docs, tmp_path):
    rows = sharding.with_shard(odd_docs, "doc_id", ["a", "b", "c"], 101).collect()
    table = sharding.fill_table(["a", "b", "c"], 101)
    assert len(rows) == odd_docs.count() and all(r.shard == "abc"[table[r.slot]] for r in rows)
    assert len({r.slot for r in rows if r.doc_id == 3}) == 1
    sharding.write_shards(odd_docs, "doc_id", ["a", "b", "c"], str(tmp_path / "out"), size=101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    assert sharding.with_shard(odd_docs.limit(0), "doc_id", ["a"]).count() == 0


def brute(text):
    words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_scan(spark, odd_docs):
    texts = [
        "Licensed under CC BY-NC 4.0.\nmit License, MIT\nLICENSE mit licenses cc by", "GNU General-Public License, version 3.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "mit licence", "x ccé by accc by", "the license of many licensed things", "apache license " * 5000,
    ]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    got = {(r.doc_id): r for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == brute(r.text)
        assert 0 <= g.score <= 1 and set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(","))
    assert got[100].labels == "cc-by,cc-by-nc,mit" and got[101].labels == "gpl,gpl-3"
    assert got[102].labels == "mit-text" and got[102].score == 1 and got[105].labels == "" and got[1].score == 0
    assert licenses.scan(odd_docs.limit(0)).count() == 0


def aligned(text):
    """label -> best share of the template's weight at one relative position, by trying every position."""
    words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))
    idf, _, weight = licenses._index()
    joined, out = f" {' '.join(words)} ", {}
    for label, template, keys in licenses.TEMPLATES:
        t = template.split()
        at = range(-len(t), len(words))
        best = max(sum(idf.get(w, 0) for k, w in enumerate(t) if 0 <= d + k < len(words) and words[d + k] == w) for d in at)
        if all(f" {k} " in joined for k in keys) and best / weight[label] >= licenses.LEAST_SCORE - 1e-9:
            out[label] = best / weight[label]
    return out


def test_other_text_takes_no_label_away(spark):
    prose = " ".join(licenses._index()[0]) + " and the river "
    notices = [f"{words}. " for _, words, _ in licenses.TEMPLATES]
    texts = notices + [prose + n for n in notices] + [n + prose * 3 for n in notices] + ["".join(notices), "".join(notices[::-1]) + prose, prose]
    texts += ["licensed gnu general public license version 3 " + prose, "license version 3 of the gnu general public license version 3"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        base, want = brute(text)[4], aligned(text)
        assert got[k].labels == ",".join(sorted(set(want) | set(filter(None, base.split(","))))), text
        assert abs(got[k].score - (1 if base else max(want.values(), default=0))) < 1e-5, text
    for k, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert all(label in got[j].labels.split(",") for j in (k, k + len(notices), k + 2 * len(notices), 3 * len(notices)))


def test_table_filling_against_preference_lists():
    """Each shard's whole preference list, and turns taken over them one claim at a time."""
    import hashlib

    for names, size in ((["a", "b", "c"], 7), ([f"s{k}" for k in range(9)], 101), (["one"], 2)):
        lists = []
        for n in names:
            d = hashlib.md5(n.encode()).digest()
            start, step = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:], "big") % (size - 1) + 1 if size > 2 else 1
            lists.append([(start + k * step) % size for k in range(size)])
            assert sorted(lists[-1]) == list(range(size))
        owner: dict = {}
        while len(owner) < size:
            for s, wanted in enumerate(lists):
                free = [x for x in wanted if x not in owner]
                if free:
                    owner[free[0]] = s
        table = sharding.fill_table(names, size)
        assert table == [owner[k] for k in range(size)]
        counts = [table.count(s) for s in range(len(names))]
        assert max(counts) - min(counts) <= 1

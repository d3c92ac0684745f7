"""License scan by a positional index of licence words.

Templates are short public notices. An index holds, for each word of a
template, its positions; a word's weight is its inverse document frequency over
the templates. A template counts only when its mandatory key phrases stand in the
file. Then every place of each of its words in the file votes for position in file
- position in template, and the largest sum of weights at one relative position is
the template's alignment. So what else a file holds takes no label away.
Besides, fixed phrases are located word by word (the base labels).

All is column expressions on the row itself: no shuffle, no join, no Python, so
hot groups and lost executors need no care. The word list of a text is built only
where a cheap pattern finds a licence word.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import lower_ascii, text_or_empty

#: A word is a run of these characters, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The same runs before lower-casing.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrase and label.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: label, template words, mandatory key phrases.
TEMPLATES = [
    ("gpl-3", "licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license", ["general public license", "version 2"]),
    ("lgpl", "gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("agpl", "gnu affero general public license as published by the free software foundation", ["affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["cc0", "public domain"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "is hereby granted"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
]

#: Words that also stand in ordinary prose: no index entries.
COMMON = "a and any are as by for in is of or that the this to with".split()

#: The share of a template's weight that must align.
LEAST_SCORE = 0.5


def _index():
    holders: dict[str, set[str]] = {}
    for label, words, _ in TEMPLATES:
        for w in words.split():
            if w not in COMMON:
                holders.setdefault(w, set()).add(label)
    idf = {w: round(math.log(1 + len(TEMPLATES) / len(x)), 6) for w, x in holders.items()}
    postings: dict[str, list[tuple[str, int]]] = {}
    weight: dict[str, float] = {}
    for label, words, _ in TEMPLATES:
        for at, w in enumerate(words.split()):
            if w in idf:
                postings.setdefault(w, []).append((label, at))
                weight[label] = weight.get(label, 0.0) + idf[w]
    return idf, postings, weight


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    hit = lambda x, i: F.when(_all([x == parts[0], *(F.get(words, i + k) == p for k, p in enumerate(parts) if k)]), i)
    return F.array_compact(F.transform(words, hit))


def _votes(label: str, postings: dict, idf_map: Column) -> Column:
    """(relative position, weight) of each hit's postings in one template."""
    posts = {w: at for w, p in sorted(postings.items()) if (at := [k for name, k in p if name == label])}
    at_map = F.create_map(*(x for w, at in posts.items() for x in (F.lit(w), F.array(*map(F.lit, at)))))
    vote = lambda h, p: F.struct((h["at"] - p).alias("d"), F.element_at(idf_map, h["word"]).alias("w"))
    own = F.filter("_hits", lambda h: h["word"].isin(*posts))
    return F.flatten(F.transform(own, lambda h: F.transform(F.element_at(at_map, h["word"]), lambda p: vote(h, p))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text counts as empty: no words, no labels, score 0, null positions.
    Repeated rows each give their row, an empty table gives an empty table,
    other columns are not read. Labels of equal score are all given. score is 1
    where a base phrase stands, else the best share of a template's weight that
    aligns at one relative position.
    """
    text = text_or_empty(text_col)
    words = F.regexp_extract_all(lower_ascii(F.col("_text")), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col(id_col), text.alias("_text")).withColumn("_w", F.when(_likely(F.lower("_text")), words))
    rows = rows.withColumn("n_words", F.when(F.col("_w").isNull(), F.regexp_count("_text", F.lit(RAW_WORD))).otherwise(F.size("_w")).cast("long"))
    return _looked_up(rows.drop("_text"), id_col)


def _likely(low: Column) -> Column:
    """Holds wherever a base phrase or the key phrases of a template can stand; ``low`` may lower-case other letters too."""
    loose = [F.contains(low, F.lit(x)) for x in ("license", "cc0", "permission", "redistribution", "unencumbered")]
    return reduce(lambda a, b: a | b, loose) | (F.contains(low, F.lit("cc")) & low.rlike(f"cc{GAP}by"))


def _looked_up(rows: DataFrame, id_col: str) -> DataFrame:
    """Labels of rows with words ``_w``, null where none can stand."""
    idf, postings, weight = _index()
    words = F.col("_w")
    rows = rows.withColumn("_joined", F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")))
    bases = {label: F.when(F.contains("_joined", F.lit(f" {phrase} ")), _places(words, phrase)) for phrase, label in BASE_PHRASES.items()}
    rows = rows.withColumns({f"_p{k}": F.coalesce(v, F.array().cast("array<int>")) for k, v in enumerate(bases.values())})
    every = F.flatten(F.array(*(F.col(f"_p{k}") for k in range(len(bases)))))

    idf_map = F.create_map(*(x for w in sorted(idf) for x in (F.lit(w), F.lit(idf[w]))))
    rows = rows.withColumn("_keys", F.array(*(_all([F.contains("_joined", F.lit(f" {k} ")) for k in keys]) for _, _, keys in TEMPLATES))).drop("_joined")
    hits = F.array_compact(F.transform(words, lambda x, i: F.when(x.isin(*sorted(idf)), F.struct(x.alias("word"), i.alias("at")))))
    rows = rows.withColumn("_hits", F.when(F.array_contains("_keys", True), hits))

    scores = []
    for k, (label, _, _) in enumerate(TEMPLATES):
        votes = _votes(label, postings, idf_map)
        zero = F.struct(F.lit(None).cast("int").alias("d"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

        def fold(acc, v):
            total = F.when(acc["d"].eqNullSafe(v["d"]), acc["sum"]).otherwise(F.lit(0.0)) + v["w"]
            return F.struct(v["d"].alias("d"), total.alias("sum"), F.greatest(acc["best"], total).alias("best"))

        best = F.aggregate(F.array_sort(votes), zero, fold, lambda acc: acc["best"])
        share = F.least(F.lit(1.0), F.round(best / weight[label], 6))
        scores.append(F.when(F.get("_keys", F.lit(k)), F.struct(F.lit(label).alias("label"), share.alias("score"))))
    rows = rows.withColumn("_found", F.filter(F.array_compact(F.array(*scores)), lambda s: s["score"] >= LEAST_SCORE))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, label in enumerate(bases))))
    own = F.transform("_found", lambda s: s["label"])
    has_base = F.size(base_labels) > 0
    return rows.withColumn("_all", every).select(
        F.col(id_col),
        "n_words",
        F.size("_all").cast("long").alias("n_base"),
        F.array_min("_all").cast("long").alias("first_word"),
        F.array_max("_all").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, own))), ",").alias("labels"),
        F.when(has_base, 1.0).otherwise(F.coalesce(F.array_max(F.transform("_found", lambda s: s["score"])), F.lit(0.0))).alias("score"),
    )

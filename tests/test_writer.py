import random

import pytest

from scriptorium.operators import writer as W
from scriptorium.sources.markdown import parse_page

PAGE = "---\ntitle: A\ntags: [x]\naliases:\n  - b\n---\n\n# A\n\n## Facts\n\n- one\n\n## Notes\n\nText [[Old#h|z]] and [[OLD]].\n"


def test_splices():
    out = W.splice(PAGE, [("set", "title", "yes"), ("append", "tags", "y: z"), ("append", "aliases", "c"), ("under", "Facts", "- two"), ("replace", "Notes", "New."), ("append", "extra", "q")])
    page = parse_page("p", out.encode())
    assert page["title"] == "yes" and page["tags"] == ["x", "y: z"] and page["aliases"] == ["b", "c"]
    assert [i["raw"] for i in page["items"]] == ["- one", "- two"] and page["sections"][2]["raw"].endswith("\n\nNew.")
    assert W.rename_links(PAGE, "old", "New") == (PAGE.replace("[[Old#h|z]]", "[[New#h|z]]").replace("[[OLD]]", "[[New]]"), 2)
    assert W.close_line("a\nb\r\nc", 2, "retracted 2026-01-01") == "a\nb (retracted 2026-01-01)\r\nc"
    for bad in ([("set", "a", "1"), ("set", "a", "2")], [("remove", "none", "")], [("under", "Nothing", "x")], [("what", "a", "b")]):
        with pytest.raises(W.SpliceRefused):
            W.splice(PAGE, bad)


def test_fuzz_only_touched_lines_change():
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randint(1, 5)
        body = "".join(f"## S{k}\n\n" + "\n".join(f"- item {rng.randrange(9)}" for _ in range(rng.randint(1, 4))) + "\n\n" for k in range(n))
        text = rng.choice(["", "﻿"]) + f"---\ntitle: T\ntags: [{', '.join('abc'[: rng.randint(0, 3)])}]\n---\n\n{body}"
        text = text.replace("\n", "\r\n") if rng.random() < 0.5 else text
        k = rng.randrange(n)
        out = W.splice(text, [("under", f"S{k}", "- new"), ("append", "tags", "zz")])
        assert ("\r\n" in out) == ("\r\n" in text) and out.startswith("﻿") == text.startswith("﻿")
        before, after = text.splitlines(), out.splitlines()
        assert [x for x in after if x != "- new" and "tags" not in x.lower()] == [x for x in before if "tags" not in x.lower()]


def test_apply(spark):
    pages = spark.createDataFrame([("a", PAGE), ("b", PAGE)], "path string, text string")
    ops = spark.createDataFrame([("a", 2, "set", "title", "B"), ("a", 1, "append", "tags", "new"), ("c", 1, "set", "x", "y")], "path string, seq int, op string, key string, value string")
    got = {r.path: r for r in W.apply(pages, ops).collect()}
    assert set(got) == {"a", "c"} and "title: B" in got["a"].text and "tags: [x, new]" in got["a"].text and got["c"].refused == "no such page"

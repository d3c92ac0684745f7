import json
import subprocess

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import cel
from scriptorium.plans import law as L
from scriptorium.plans.bundle import Bundle
from scriptorium.sources import git, markdown
from scriptorium.sources.yamlcore import YamlRefused, read_yaml

TYPE = """
type: bed-page
role: concept
description: One garden bed.
fragments: [dated]
fields:
  type: object
  properties: { area: { type: integer, minimum: 1 } }
  required: [area]
sections:
  ordered: true
  additional: refused
  list:
    - { heading: Facts, min: 1, grammar: claims, provenance: required, vocabulary: facts }
    - { heading: Relations, grammar: relations, require: [{ labels: [next-to], min: 1 }] }
    - { heading: History, max: 1, grammar: entries, lifecycle: append-only }
rules:
  - { id: big, expr: "page.fields.area < 100", message: too large }
"""
FRAGMENT = """
fragment: dated
rules:
  - { id: day-entries, section: History, expr: 'section.items.all(i, i.precision == "day")', severity: warning, message: to the day }
"""
GOOD = """---
type: bed-page
title: East
area: 12
tags: [herb]
---

# East

## Facts

- [soil] Sandy loam (https://example.org/soil)
  dug twice

## Relations

- next-to [[West]]

## History

- 2025-03-02 — Limed the soil.
- 2025-08-19 — Moved the hurdles.
"""


@pytest.fixture()
def root(tmp_path):
    files = {
        "config/engine.json": json.dumps({"label": "t", "content_roots": ["wiki"]}), "constitution/types/bed-page.yaml": TYPE, "constitution/fragments/dated.yaml": FRAGMENT,
        "constitution/vocabularies/tags.yaml": "vocabulary: tags\nmode: registered\nentries: { herb: null }\nretired: { weed: { successor: herb } }\n",
        "constitution/vocabularies/facts.yaml": "vocabulary: facts\nmode: registered\nentries: { soil: null }\n", "wiki/East.md": GOOD, "wiki/West.md": GOOD.replace("East", "West").replace("[[West]]", "[[east]]"),
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def codes(result):
    return {(f["path"].rpartition("/")[2], f["rule"]) for f in result["findings"] if f["severity"] != "info"}


def test_clean_bundle(spark, root):
    result = Bundle(spark, str(root)).check()
    assert codes(result) == set() and result["exit"] == 0


def test_broken_pages(spark, root):
    bad = GOOD.replace("area: 12", "area: 0\nextra: 1").replace("[herb]", "[weed, other]").replace("(https://example.org/soil)", "").replace("[[West]]", "[[Nowhere]]").replace("2025-08-19", "2025-08").replace("next-to", "near")
    (root / "wiki/Bad.md").write_text(bad + "\n## History\n\n- broken\n\n## Odd\n\n[[West]] `[[Not]]`\n")
    (root / "wiki/Dup.md").write_text("---\ntype: bed-page\ntype: x\n---\n")
    (root / "wiki/Latin.md").write_bytes(b"\xff\xfe")
    (root / "wiki/None.md").write_text("no type")
    (root / "wiki/sub").mkdir()
    (root / "wiki/sub/east.md").write_text(GOOD.replace("area: 12", "area: 500"))
    result = Bundle(spark, str(root)).check()
    want = {
        ("Bad.md", "page-shape-invalid"), ("Bad.md", "vocabulary-retired"), ("Bad.md", "vocabulary-unknown"), ("Bad.md", "claim-provenance"), ("Bad.md", "relation-target-unresolved"), ("Bad.md", "wikilink-unresolved"), ("Bad.md", "day-entries"),
        ("Bad.md", "require-unmet"), ("Bad.md", "section-count"), ("Bad.md", "section-undeclared"), ("Bad.md", "item-unparsed"), ("Dup.md", "duplicate-key"), ("Latin.md", "page-not-utf8"), ("None.md", "type-unknown"), ("None.md", "okf-missing-type"), ("east.md", "big"), ("east.md", "identity-collision"),
    }
    assert codes(result) == want and result["exit"] == 5
    bundle = Bundle(spark, str(root))
    assert bundle.search("west").first().path == "wiki/West.md"
    assert ("wiki/West.md", "tag:herb") in {(r["from"], r["to"]) for r in bundle.graph().collect()}


def test_gate(spark, root):
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "start")
    head = git.git(str(root), "rev-parse", "HEAD").decode().strip()
    text = GOOD.replace("- 2025-03-02 — Limed the soil.", "- 2025-03-02 — Limed it twice.").replace("- [soil] Sandy loam (https://example.org/soil)\n  dug twice", "- [soil] Clay (https://example.org/soil)").replace("- next-to [[West]]", "- next-to [[East]]")
    (root / "wiki/East.md").write_text(text)
    run("add", "-A")
    got = {f["rule"] for f in Bundle(spark, str(root)).gate()["findings"]}
    assert got == {"entry-edited", "claims-transition", "relation-removed"}
    assert git.pin_state(str(root), head, ["wiki"]) == ("current", 0)
    run("commit", "-qm", "more")
    assert git.pin_state(str(root), head, ["wiki/East.md"]) == ("stale", 1) and git.pin_state(str(root), head, ["constitution"]) == ("unchanged", 1) and git.pin_state(str(root), "0" * 40, []) == ("unknown", None)
    assert git.revision_state(spark, str(root), head, ["wiki"]).count() == 2


PLOT = """
type: plot
role: concept
description: A plot.
fields:
  type: object
  properties: { beside: { $ref: "#/$defs/page-ref" } }
sections:
  list:
    - { heading: Notes }
    - { heading: Facts, grammar: claims, provenance: optional }
rules:
  - { id: no-frost, section: Notes, expr: '!section.raw.contains("frost")', message: frost }
  - { id: facts-stay, section: Facts, expr: '!before.present || !has(before.section) || before.section.items.size() <= section.items.size()', message: facts went }
  - { id: cites-page, section: Facts, expr: '!before.present || before.section.items.all(i, i.provenance.kind != "page" || i.provenance.page.resolved)', severity: warning, message: cited nothing }
"""


def _plots(root, files):
    import shutil

    shutil.rmtree(root / "wiki")
    for name, text in files.items():
        (root / "wiki" / name).parent.mkdir(parents=True, exist_ok=True)
        (root / "wiki" / name).write_text(text)


def test_gate_follows_names_and_sections(spark, root):
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    (root / "constitution/types/plot.yaml").write_text(PLOT)
    plot = lambda beside, notes, facts="": f"---\ntype: plot\n{beside}---\n\n## Notes\n\n{notes}\n\n## Facts\n\n{facts}"
    names = {"B.md": plot("", "Chalk and flint up to the hedge."), "Old.md": plot("", "Dry."), "D.md": plot("", "Peat below, gravel above.")}
    files = names | {
        "A.md": plot("beside: B\n", "Wet."), "C.md": plot("", "Warm."), "E.md": plot("beside: Old\n", "Sandy."), "Cold.md": plot("", "Late frost."), "F.md": plot("beside: D\n", "Clay.", "- [soil] One ([[B]])\n- [soil] Two ([[Nobody]])\n"),
    }
    _plots(root, files)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "start")
    # B goes although A names it, Old moves without an alias although E names it, C's section changes below its heading,
    # Cold keeps its old frost and gains a line elsewhere, F loses a fact
    (root / "wiki/B.md").unlink()
    run("mv", "wiki/Old.md", "wiki/sub-new.md")
    (root / "wiki/C.md").write_text(files["C.md"].replace("Warm.", "Early frost."))
    (root / "wiki/Cold.md").write_text(files["Cold.md"] + "- [soil] New\n")
    (root / "wiki/F.md").write_text(files["F.md"].replace("- [soil] Two ([[Nobody]])\n", ""))
    run("add", "-A")
    with Bundle(spark, str(root)) as bundle:
        assert {r.path for r in git.removed_pages(spark, str(root), ["wiki"]).collect()} == {"wiki/B.md"}
        out = bundle.gate(None)
    got = {(f["path"].rpartition("/")[2], f["rule"], f["severity"]) for f in out["findings"]}
    assert out["exit"] == 5 and out["scoped"]
    assert {("A.md", "page-ref-type", "error"), ("E.md", "page-ref-type", "error"), ("C.md", "no-frost", "error"), ("Cold.md", "no-frost", "warning"), ("F.md", "facts-stay", "error"), ("F.md", "cites-page", "warning"), ("sub-new.md", "renamed-without-alias", "error")} <= got
    assert not {r for p, r, _ in got if p in ("A.md", "E.md")} - {"page-ref-type"} and ("F.md", "page-ref-type", "error") not in got
    # without a base a rule on the section before can't be judged
    with Bundle(spark, str(root)) as bundle:
        told = bundle.check(None)
    assert {"facts-stay", "cites-page"} <= set(told["unevaluated"]) and told["unevaluated"]["facts-stay"] == ["no-base"]
    # an alias that keeps the old name, and A no longer naming B, let the commit through
    (root / "wiki/sub-new.md").write_text(plot("aliases: [Old]\n", "Dry."))
    (root / "wiki/A.md").write_text(plot("beside: D\n", "Wet."))
    (root / "wiki/C.md").write_text(files["C.md"])
    (root / "wiki/F.md").write_text(files["F.md"])
    run("add", "-A")
    with Bundle(spark, str(root)) as bundle:
        out = bundle.gate(None)
    assert out["exit"] == 0, out["findings"]


def test_parser():
    page = markdown.parse_page("a.md", "---\r\ntype: x\n---\n# A\n\n```\n# not\n- no\n```\n> # quoted\n\n## B\n- one\n    - deeper\n1. two\n\nTitle\n---\n## B\n- three\n".encode())
    assert [(s["heading"], s["depth"], s["address"]) for s in page["sections"]] == [("A", 1, "A#0"), ("B", 2, "A#0/B#0"), ("Title", 2, "A#0/Title#0"), ("B", 2, "A#0/B#1")]
    assert [(i["raw"], i["rationale"], i["line"]) for i in page["items"]] == [("- one", ["- deeper"], 13), ("- two", [], 15), ("- three", [], 20)]
    assert markdown.parse_claim("- [a] core (x (y)) (notes/z.md) (retracted 2026-01-02)", ("notes",)) == {"category": "a", "core": "core (x (y))", "prov_kind": "path", "prov_value": "notes/z.md", "retracted": "2026-01-02", "superseded": None, "superseded_by": None, "valid_from": None, "valid_to": None}
    assert markdown.parse_entry("- 2023-02-29 — x") is None and markdown.parse_entry("- 2024-02 — x")["precision"] == "month"


def test_pages_are_parsed_in_bounded_parts(spark):
    big = b"x" * (markdown.HELD_BYTES // 2)
    parts = lambda x: [p.stop - p.start for p in markdown._parts(x)]
    assert parts([b"x"] * 300) == [128, 128, 44] and parts([None, big, big, big + big + b"x", b"x"]) == [3, 1, 1] and parts([]) == []
    files = spark.createDataFrame([(f"{k}.md", bytearray(b"## A\n- [c] %d\n" % k)) for k in range(300)], "path string, content binary").coalesce(1)
    assert [(r.path, r["items"][0].claim.core) for r in markdown.parse(files).collect()] == [(f"{k}.md", str(k)) for k in range(300)]


def test_byte_spans_of_sections_and_records(spark):
    text = "---\ntype: x\n---\n\n## Ä\n\n- [a] é\n  more\n- [b] z\n\n### In\n\ntext\n\n## End\n"
    page = markdown.parse_page("a.md", text.replace("\n", "\r\n").encode())
    cut = lambda s: text.encode()[s[0] : s[1]].decode()
    assert [cut(s["span"]) for s in page["sections"]] == [s["raw"] for s in page["sections"]] == ["## Ä\n\n- [a] é\n  more\n- [b] z\n\n### In\n\ntext", "### In\n\ntext", "## End"]
    assert [cut(s["direct_span"]) for s in page["sections"]] == [s["direct"] for s in page["sections"]] and cut(page["sections"][0]["direct_span"]).endswith("z")
    assert [cut(i["span"]) for i in page["items"]] == ["- [a] é\n  more", "- [b] z"]
    rows = spark.createDataFrame([([3, 9],)], "span array<long>")
    env = {"section": {"location": {"span": F.col("span")}}}
    assert rows.select(cel.compile_rule("section.location.span[1] - section.location.span[0] == 6", env)).first()[0]


def test_blocks_of_markdown():
    cases = {
        "# A\n> # q\n\n- item\n\n  # in item\n  ---\n# B": ["A", "B"], "> para\nlazy\n===\n# C": ["C"], "Title\ntwo\n===": ["Title two"], "1. a\n\n   ```\n   # x\n   ```\n\n# Y": ["Y"], "para\n- item\n---\n# h": ["h"],
        "<div>\n# no\n\n# yes": ["yes"], "<!-- a\n\n# no\n-->\n# yes": ["yes"], "text\n<b>\n# yes": ["yes"], "<b>\n# no\n\n# yes": ["yes"], "<script>\n\n# no\n</script>\n# y": ["y"], "<?a\n# no\n?>\n# y": ["y"], "<![CDATA[\n# no\n]]>\n# y": ["y"],
        "    # code\n# h": ["h"], "para\n    # on": [], "> ```\n# out": ["out"], "- a\n    - b\n      # n\n  # m\n# top": ["top"], "* * *\n# x": ["x"], "a\n2. b\n# c": ["c"], "-\n  # in\n# out": ["out"], "- a\n\n\n  # b\n\nc\n---": ["c"],
    }
    for text, want in cases.items():
        assert [t for _, _, t in markdown.blocks(text.split("\n"))[0]] == want, text
    page = markdown.parse_page("a.md", b"    [[code]]\n\n[[one]] ``[[two]] ` [[three]]``\n> ~~~\n> [[four]]\n> ~~~\n> [[five]]\n<p>\n[[six]]\n\n[[seven]]\n")
    assert [(x["target"], x["line"]) for x in page["links"]] == [("one", 3), ("five", 7), ("seven", 11)]


def test_relaxed_shapes_and_admission(root):
    (root / "constitution/types/bed-page.yaml").write_text(TYPE.replace("area: { type: integer, minimum: 1 }", "area: { type: integer, minimum: 1, maximum: 9, default: 2 }, kind: { enum: [a, b] }, name: { type: string, minLength: 2 }"))
    child = "type: {}\nextends: bed-page\nrole: concept\ndescription: x\nmeta: [{}]\nfields: {{ type: object, properties: {{ {} }} }}\n"
    (root / "constitution/types/narrow.yaml").write_text(child.format("narrow", "area", "area: { type: integer, minimum: 2, maximum: 9, default: 2 }, kind: { enum: [b] }"))
    L.load(str(root))
    (root / "constitution/types/wide.yaml").write_text(child.format("wide", "nowhere", "area: { type: number, minimum: 0, maximum: 10, default: 3 }, kind: { enum: [b, c] }, name: { minLength: 1 }"))
    with pytest.raises(L.LawRefused) as e:
        L.load(str(root))
    told = {(c, m.split(":")[0]) for c, w, m in e.value.issues if w == "wide"}
    assert told == {("shape-relaxed", f"fields/properties/{k}") for k in ("area/type", "area/minimum", "area/maximum", "kind/enum", "name/minLength")} | {("default-conflict", "fields/properties/area/default"), ("meta-unknown", "meta names nowhere, which no field is")}
    side = " && ".join(f'page.tags.all(t{k}, t{k} != "x")' for k in range(5))
    cel.admit(side.rpartition(" && ")[0])
    inner = " && ".join(f"config.b.exists({v}, {v} == x)" for v in "pqrs")
    cel.admit(f"config.a.all(x, {inner}) && config.a.all(y, y == 1) && config.a.all(z, z == 1)", {"a": [1], "b": [1]})
    with pytest.raises(cel.RuleRefused):
        cel.admit(side)


def test_yaml():
    assert read_yaml("a: 0o10\nb: 9223372036854775808\nc: yes\nd: ~\ne: 1e3")[0] == {"a": 8, "b": 9223372036854775808.0, "c": "yes", "d": None, "e": 1000.0}
    for bad, code in (("a: 1\na: 2", "duplicate-key"), ("a: [", "malformed-frontmatter"), ("a: &x [*x]", "malformed-frontmatter")):
        with pytest.raises(YamlRefused) as e:
            read_yaml(bad)
        assert e.value.code == code


def test_law_refusals(root):
    (root / "constitution/types/child.yaml").write_text("type: child\nextends: nothing\nrules:\n  - { id: x, expr: 'a ==', message: m }\n")
    with pytest.raises(L.LawRefused) as e:
        L.load(str(root))
    assert {(c, w) for c, w, _ in e.value.issues} == {("type-invalid", "child")}


def test_git_framing():
    assert git.parse_name_status(b"R100\0a\0b\0M\0c\0") == [("R", "b", "a"), ("M", "c", None)]
    assert git.parse_batch(b"x blob 3\nabc\ny missing\n", 2) == [b"abc", None]
    for bad in (b"x blob 5\nabc\n", b""):
        with pytest.raises(git.GitAnswerRefused):
            git.parse_batch(bad, 1)

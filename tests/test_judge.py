"""Checks beyond one page's grammar: references, folders, exceptions, sources, rules with their environment, drafts, law changes."""

import hashlib
import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import cel
from scriptorium.functions import text as T
from scriptorium.operators import evidence, transitions, verdict
from scriptorium.plans import artifacts, cli, lawdiff, lawtests, reading, writing
from scriptorium.plans import law as L
from scriptorium.plans.bundle import Bundle
from scriptorium.sources import git, markdown, states

FIELD = """
type: field
role: concept
description: A field.
fields:
  type: object
  properties:
    crop: { $ref: "#/$defs/page-ref", target_type: crop }
    source: { type: string, format: uri }
    updated: { type: string, format: date }
    pin: { $ref: "#/$defs/pin" }
sections:
  list:
    - { heading: Facts, grammar: claims, provenance: optional, scope: descendants }
    - { heading: Links, grammar: relations, history: Log, vocabulary: lib/labels }
    - { heading: Log, grammar: entries }
    - { heading: Deep, under: [Facts], max: 1 }
rules:
  - { id: crop-links, section: Links, expr: 'section.items.all(i, !i.target.resolved || i.target.type in config.kinds || (i.target.type in facts.ancestry && facts.ancestry[i.target.type].exists(t, t in config.kinds)))', config: { kinds: [plant] }, severity: warning, message: names no plant }
  - { id: hosts, expr: '!has(page.fields.source) || page.urls["source"].host in config.hosts', config: { hosts: [farm.example] }, message: foreign host }
  - { id: grows, expr: '!before.present || page.body.trim().startsWith(before.page.body.trim())', message: body shrank }
  - { id: cited, section: Facts, expr: 'section.items.all(i, i.provenance.kind != "page" || i.provenance.page.resolved)', message: cites nothing }
  - { id: odd, expr: 'page.tags.all(t, t.gone == 1)', message: never }
"""
PAGES = {
    "wiki/east/Rye field.md": "---\ntype: field\ntags: [east]\ncrop: Rye\nsource: https://farm.example/x\n---\n\n## Facts\n\n- [soil] Sandy [x] (src/a.txt)\n- [soil] Wet (src/none.txt)\n- [soil] Cold (src/a.txt/)\n\n### Inner\n\n- [soil] Deep down ([[Nobody]])\n\n## Links\n\n- grows [[Rye]]\n- near [[Oats]]\n\n## Log\n\n- 2024-01-02 — Opened.\n",
    "wiki/west/Oats.md": "---\ntype: field\ntags: [north]\ncrop: West field\nsource: https://other.example/\nexceptions:\n  - { rule: hosts, reason: the old survey }\n  - { rule: section-count, reason: none }\n  - { rule: nothing, reason: none }\n---\n\n## Facts\n\n### Deep\n\n### Deep\n",
    "wiki/Rye.md": "---\ntype: crop\naliases: [Secale]\n---\n\nSee [[Secale]].\n",
}
FILES = PAGES | {
    "config/engine.json": json.dumps({"label": "t", "content_roots": ["wiki"], "source_roots": ["src"], "libraries": [{"path": "shared/kit-lib"}], "folder_tags": {"mode": "materialize-add-only"}, "commit_prefixes": ["docs"]}),
    "constitution/types/field.yaml": FIELD, "constitution/types/crop.yaml": "type: crop\nextends: plant\nrole: concept\ndescription: A crop.\n", "constitution/types/plant.yaml": "type: plant\nabstract: true\nrole: concept\ndescription: Any plant.\n",
    "constitution/vocabularies/tags.yaml": "vocabulary: tags\nmode: registered\nentries: { east: null, north: null }\n", "shared/kit-lib/vocabularies/labels.yaml": "vocabulary: labels\nmode: registered\nentries: { grows: null }\nretired: { near: { successor: grows } }\n",
    "src/a.txt": "one\ntwo\n", "rule-tests/hosts/negative.md": "---\ntype: field\nsource: https://other.example/\n---\n", "rule-tests/hosts/repaired.md": "---\ntype: field\nsource: https://farm.example/\n---\n", "rule-tests/hosts/positive/none.md": "---\ntype: field\n---\n",
    "rule-tests/hosts/expect.json": '{"rule": "hosts", "location": "page"}', "rule-tests/gone/negative.md": "x",
}


@pytest.fixture()
def root(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def run(root, *args):
    return subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.org", *args], check=True, capture_output=True).stdout.decode().strip()


def test_verdict_of_a_bundle(spark, root):
    (root / "wiki/link.md").symlink_to(root / "wiki/Rye.md")
    with Bundle(spark, str(root), parsed=str(root / ".parsed")) as bundle:
        out = bundle.check(None)
        got = {(f["path"].rpartition("/")[2], f["rule"], (f["details"] or {}).get("kind") or (f["details"] or {}).get("rule")) for f in out["findings"] if f["rule"] != "unevaluated"}
        assert got == {
            ("Rye field.md", "source-path-missing", None), ("Rye field.md", "source-path-kind", None), ("Rye field.md", "vocabulary-retired", None), ("Rye field.md", "cited", "cited"), ("Rye field.md", "crop-links", "crop-links"),
            ("Rye field.md", "rule-error", "error"), ("Oats.md", "rule-error", "error"), ("Oats.md", "page-ref-type", "unresolved"), ("Oats.md", "exception-applied", "hosts"), ("Oats.md", "exception-illegal", "nothing"), ("Oats.md", "folder-segment-registered", None),
            ("Oats.md", "folder-tags-present", None), ("Oats.md", "exception-applied", "section-count"), ("Rye.md", "wikilink-alias-target", None), ("link.md", "path-skipped", None), ("Rye field.md", "wikilink-unresolved", None),
        } | {("Rye field.md", "relation-target-unresolved", None)} - {("Rye field.md", "relation-target-unresolved", None)}
        assert out["excepted"] == {"hosts": 1, "section-count": 1} and out["exit"] == 5 and out["unevaluated"]["grows"] == ["no-base"]
        cells = {r["rule"]: (r["evaluated"], r["not_applicable"], r["unevaluated"]) for r in out["coverage"]}
        assert cells["hosts"] == (2, 1, 0) and cells["grows"] == (0, 1, 2) and cells["claims-transition"] == (0, 1, 2)
        assert out["scope"] == {"governed": 5, "prose": 2, "unbound": 0, "parsed_records": 7, "malformed_items": 0, "unbound_preambles": 1}
        tried = bundle.try_rule("field", 'size(page.tags) > 0 && page.tags[0] == "east"')
        assert [x["path"] for x in tried["would_refuse"]] == ["wiki/west/Oats.md"] and tried["would_pass"] == ["wiki/east/Rye field.md"] and not tried["errors"]


def test_reading_search_and_files(spark, root):
    (root / "wiki/east/Rye field.md").write_text(PAGES["wiki/east/Rye field.md"].replace("\n", "\r\n"))
    with Bundle(spark, str(root)) as bundle:
        page = bundle.read("rye FIELD", budget=90)
        assert page["page"]["resolved_via"] == "name" and page["page"]["type"] == "field" and page["status"]["reason"].startswith("source-path-") and page["omitted"][-1]["reason"] == "budget"
        assert all(p["text"].endswith("\r\n") for p in page["sections"]) and bundle.read("Rye")["status"] == {"stale": False, "reason": None, "unresolved": None, "unresolved_reason": "queue-missing"}
        assert [p["heading"] for p in bundle.read("wiki/east/Rye field.md", "facts")["sections"]] == ["Facts"] and bundle.read("Secale")["page"]["resolved_via"] == "alias"
        with pytest.raises(reading.NotFound):
            bundle.read("Barley")
        found = bundle.search_report("rye", limit=1, near=True, kind="plant")
        assert [r["path"] for r in found["results"]] == ["wiki/Rye.md"] and found["coverage"]["caps"] == {"limit": 1, "found": 1, "hit": False, "near_limit": 20, "near_found": 1, "near_hit": False} and found["near"]
        assert [r["path"] for r in bundle.search_report(None, tag="EAST")["results"]] == ["wiki/east/Rye field.md"]
        assert bundle.search_items("sandy").first().line == 10
        files = artifacts.plans(bundle)
        planned = {p: f.text() for p, f in files.items()}
        digests = {p: f.digest() for p, f in files.items()}
        assert digests == {p: hashlib.sha256(t.encode()).hexdigest() for p, t in planned.items()}
        assert {(r.path, r.rule) for r in artifacts.drift_findings(bundle, digests, digests | {"generated/graph.json": "0"}).collect()} == {("generated/graph.json", "generated-drift")}
        manifest = json.loads(planned["generated/manifest.json"])
        assert manifest["totals"] == {"pages": 3, "edges": 6} and manifest["by_label"] == {"relation": {"grows": 1, "near": 1}} and manifest["by_kind"] == {"relation": 2, "tagged": 2, "wikilink": 2}
        assert next(p for p in manifest["pages"] if p["path"] == "wiki/Rye.md")["inbound"] == {"relation": {"grows": ["wiki/east/Rye field.md"]}, "wikilink": ["wiki/east/Rye field.md"]}
        law, content, rows = artifacts.read_queue(planned[artifacts.QUEUE])
        assert (law, content) == (bundle.law.digest(), bundle.digest()) and ("wiki/west/Oats.md", "page-ref-type") in rows and ("wiki/west/Oats.md", "exception-applied") not in rows
        assert artifacts.read_queue("x") is None and "| north | active |" in planned["generated/tag-catalog.md"] and "`field` (concept)" in planned["generated/BRIEF.md"]
        assert writing.fix_folder_tags(bundle)["wiki/west/Oats.md"].decode().startswith("---\ntype: field\ntags: [north, west]")
        assert "## Links" in bundle.types("field")[0]["skeleton"] and "### Deep" in bundle.types("field")[0]["skeleton"] and len(bundle.types(concrete=True, brief=True)) == 2


def test_rendered_files_are_the_same_whatever_their_ranges(spark, root):
    for k in range(12):
        (root / f"wiki/east/Odd {k}.md").write_text(f'---\ntype: field\ntags: [east]\ncrop: Rye\ntitle: "a \\"{k}\\" | \U0001f33e"\n---\n\n## Links\n\n- grows [[Rye]]\n')
    with Bundle(spark, str(root)) as bundle:
        files = {lines: (artifacts.graph_file(bundle, lines), artifacts.manifest_file(bundle, lines), artifacts.queue_file(bundle.findings(), "0" * 64, "1" * 64, lines)) for lines in (None, 20)}
        one, many = ([f.text() for f in own] for own in files.values())
        assert one == many and files[20][1].pieces[1].count > 20 * 6
        graph, manifest = json.loads(one[0]), json.loads(one[1])
        assert one[0] == json.dumps(graph, indent=2, ensure_ascii=False) + "\n" and one[1] == json.dumps(manifest, indent=2, ensure_ascii=False) + "\n"
        edges = {(e["from"], e["to"], e["kind"], e.get("label")) for e in graph["edges"]}
        assert edges == {tuple(r) for r in bundle.graph().collect()} and len(graph["edges"]) == len(edges)
        assert [n["id"] for n in graph["nodes"]] == sorted(r.id for r in bundle.nodes().collect()) and {"id": "tag:east", "kind": "tag"} in graph["nodes"]
        assert next(n for n in graph["nodes"] if n["id"].endswith("Odd 3.md"))["title"] == 'a "3" | \U0001f33e'
        told = {(p["path"], e[0], e[1], e[2]) for p in manifest["pages"] for k, v in p.get("outbound", {}).items() for e in ([(o, k, n) for n, own in v.items() for o in own] if k == "relation" else [(o, k, None) for o in v])}
        pages = {p["path"] for p in manifest["pages"]}
        assert told == {e for e in edges if {e[0], e[1]} <= pages}
        hub = next(p for p in manifest["pages"] if p["path"] == "wiki/Rye.md")["inbound"]["relation"]["grows"]
        assert len(hub) == 13 and hub == sorted(hub)
        assert artifacts.read_queue(one[2])[2] and one[2].count("\n| ") == len(artifacts.read_queue(one[2])[2]) + 2
        for own in files.values():
            for f in own:
                f.save(str(root / "saved"))
                assert (root / "saved").read_text() == f.text() and f.digest() == hashlib.sha256(f.text().encode()).hexdigest()
                f.drop()


def test_written_files_do_not_drift(spark, root, capsys):
    names = ["generated/BRIEF.md", "generated/graph.json", "generated/manifest.json", "generated/queue.md", "generated/tag-catalog.md"]
    (root / "generated").mkdir()
    (root / "generated/graph.json").write_text("{}")
    cli.main(["check", "--write", "--summary", "--root", str(root)], spark)  # writes, then judges what is there
    data = json.loads(capsys.readouterr().out.strip().splitlines()[-1])["data"]
    assert data["written"] == names and "generated-drift" not in data["by_rule"] and json.loads((root / "generated/graph.json").read_text())["nodes"]
    assert not list((root / "generated").glob(".write-*"))


def test_landing_puts_back_what_it_replaced(spark, root, monkeypatch):
    before = {p: (root / p).read_bytes() for p in ("wiki/Rye.md", "wiki/west/Oats.md")}
    real = os.remove
    monkeypatch.setattr(writing.os, "remove", lambda p: (_ for _ in ()).throw(OSError("full")) if str(p).endswith("Oats.md") else real(p))
    with pytest.raises(OSError):
        writing.land(str(root), {"wiki/Rye.md": b"new", "wiki/New.md": b"new"}, ["wiki/west/Oats.md"], {})
    assert {p: (root / p).read_bytes() for p in before} == before and not (root / "wiki/New.md").exists()
    assert not [p for p in (root / "wiki").rglob(".write-*")]


def test_batch_write(spark, root, tmp_path_factory):
    drafts = tmp_path_factory.mktemp("drafts")
    (drafts / "wiki/east").mkdir(parents=True)
    (drafts / "ops.json").write_text(json.dumps({"move": [{"from": "wiki/Rye.md", "to": "wiki/Winter rye.md", "reason": "named"}]}))
    (drafts / "wiki/east/New.md").write_text("---\ntype: field\ntags: [east]\ncrop: Rye\n---\n")
    (root / "constitution/types/field.yaml").write_text("\n".join(x for x in FIELD.splitlines() if "id: odd" not in x and "id: grows" not in x))
    (root / "wiki/east/Rye field.md").write_text("---\ntype: field\ntags: [east]\ncrop: Rye\n---\n\n## Facts\n\n- [soil] Good old soil\n- [soil] Better soil\n\n## Links\n\n- grows [[Rye]]\n")
    (root / "wiki/Rye.md").write_text(PAGES["wiki/Rye.md"].replace("[[Secale]]", "the field"))
    handle = markdown.parse_page("x", (root / "wiki/east/Rye field.md").read_bytes())["items"][0]["claim"]["handle"]
    with Bundle(spark, str(root)) as bundle:
        out = writing.write(bundle, str(drafts), day="2025-05-06")
        assert out["landed"], out["findings"]
        assert out["applied"][0]["rewritten_links"] == ["wiki/east/Rye field.md"] and out["applied"][0]["aliased"] and not (root / "wiki/Rye.md").exists()
    text = (root / "wiki/east/Rye field.md").read_text()
    assert "[[Winter rye]]" in text and 'updated: "2025-05-06"' in text and "aliases: [Secale, Rye]" in (root / "wiki/Winter rye.md").read_text() and 'updated: "2025-05-06"' in (root / "wiki/east/New.md").read_text()
    os.remove(drafts / "wiki/east/New.md")
    bad = [
        ({"move": [{"from": "wiki/none.md", "to": "wiki/x.md", "reason": "r"}]}, "page-not-found"), ({"move": [{"from": "wiki/Winter rye.md", "to": "wiki/west/oats.MD", "reason": "r"}]}, "invalid-path"),
        ({"move": [{"from": "wiki/Winter rye.md", "to": "wiki/west/oats.md", "reason": "r"}]}, "destination-exists"), ({"move": [{"from": "wiki/Winter rye.md", "to": "wiki/winter rye.md", "reason": "r"}]}, "move-case-only"),
        ({"retire": [{"path": "wiki/Winter rye.md", "successor": "Barley"}]}, "unknown-successor"), ({"retract": [{"path": "wiki/east/Rye field.md", "handle": "#00000000"}]}, "claim-not-found"), ({"bases": {"wiki/west/Oats.md": "0" * 64}}, "base-mismatch"),
        ({"moves": []}, "ops-invalid"), ({"retract": [{"path": "x", "handle": "#1"}]}, "ops-invalid"), ({"retract": [{"path": "x", "handle": "#00000000", "date": "2025-02-30"}]}, "ops-invalid"),
    ]
    with Bundle(spark, str(root)) as bundle:
        for ops, code in bad:
            (drafts / "ops.json").write_text(json.dumps(ops))
            with pytest.raises(writing.Refused) as e:
                writing.prepare(bundle, str(drafts))
            assert e.value.code == code
        (drafts / "ops.json").write_text(json.dumps({"retire": [{"path": "wiki/west/Oats.md", "successor": "Rye"}], "retract": [{"path": "wiki/east/Rye field.md", "handle": handle}]}))
        b = writing.prepare(bundle, str(drafts), "2025-05-07")
        assert "(retracted 2025-05-07)" in b.text("wiki/east/Rye field.md") and "status: retired\nsuperseded_by: Winter rye" in b.text("wiki/west/Oats.md")
    with pytest.raises(writing.Refused):
        writing.land(str(root), {"wiki/a.md": b"a"}, [], {"wiki/Winter rye.md": b"other"})
    assert not [p for p in (root / "wiki").iterdir() if p.name.startswith(".write-") or p.name == "a.md"]


def test_moves_as_a_table(spark, root, tmp_path_factory):
    drafts = tmp_path_factory.mktemp("drafts")
    (root / "wiki/Link.md").write_text("---\ntype: crop\n---\n\n[[Rye#x|y]] and [[oats]], [[Barley]].\n")
    move = lambda a, b: {"from": f"wiki/{a}.md", "to": f"wiki/{b}.md", "reason": "r"}
    with Bundle(spark, str(root)) as bundle:
        # Rye goes on by way of Barley, Oats takes Rye's old place
        (drafts / "ops.json").write_text(json.dumps({"move": [move("Rye", "Barley"), move("Barley", "Spelt"), move("west/Oats", "Rye")]}))
        b = writing.prepare(bundle, str(drafts), "2025-05-06")
        assert dict(b.moves) == {"wiki/Rye.md": "wiki/Spelt.md", "wiki/west/Oats.md": "wiki/Rye.md"} and b.get("wiki/west/Oats.md") is None and b.get("wiki/Barley.md") is None
        assert b.text("wiki/Link.md").endswith("[[Spelt#x|y]] and [[Rye]], [[Spelt]].\n") and "aliases: [Secale, Rye, Barley]" in b.text("wiki/Spelt.md")
        assert [(x["path"], x["aliased"], "wiki/Link.md" in x["rewritten_links"]) for x in b.applied] == [("wiki/Barley.md", True, True), ("wiki/Spelt.md", True, True), ("wiki/Rye.md", True, True)]
        for ops, code in (([move("Rye", "Spelt"), move("Rye", "Emmer")], "page-not-found"), ([move("Rye", "Spelt"), move("west/Oats", "SPELT")], "destination-exists")):
            (drafts / "ops.json").write_text(json.dumps({"move": ops}))
            with pytest.raises(writing.Refused) as e:
                writing.prepare(bundle, str(drafts))
            assert e.value.code == code


def test_gate_and_law_changes(spark, root):
    run(root, "init", "-q")
    run(root, "add", "-A")
    run(root, "commit", "-qm", "docs: start")
    page = PAGES["wiki/east/Rye field.md"]
    run(root, "mv", "wiki/Rye.md", "wiki/Barley.md")
    (root / "wiki/east/Rye field.md").write_text(page.replace("- grows [[Rye]]\n", "").replace("- 2024-01-02 — Opened.", "- 2024-01-02 — Opened.\n- 2024-01-03 — No longer: grows [[rye]]."))
    run(root, "add", "-A")
    with Bundle(spark, str(root)) as bundle:
        out = bundle.gate(None)
        got = {(f["path"].rpartition("/")[2], f["rule"], f["severity"]) for f in out["findings"] if f["rule"] not in ("unevaluated", "exception-applied")}
    assert out["scoped"] and ("Barley.md", "renamed-without-alias", "error") in got and ("Rye field.md", "relation-removed", "error") not in got and ("Rye field.md", "page-ref-type", "error") in got
    assert ("Rye field.md", "source-path-missing", "warning") in got and ("Oats.md", "page-ref-type", "error") not in got and ("Rye field.md", "grows", "error") in got
    run(root, "commit", "-qm", "docs: move")
    (root / "constitution/types/field.yaml").write_text(FIELD.replace("[farm.example]", "[farm.example, mill.example]").replace("  - { id: odd", "  - { id: new-rule, expr: 'true', message: m }\n  - { id: odd"))
    (root / "constitution/vocabularies/tags.yaml").write_text("vocabulary: tags\nmode: registered\nentries: { east: null, south: null }\n")
    run(root, "add", "-A")
    head, law = lawdiff.head_law(str(root)), L.load(L.git_snapshot(str(root), None))
    assert [c.kind for c in lawdiff.changes(head, law)] == ["rule-config", "vocabulary-entry-added", "vocabulary-entry-removed"] and lawdiff.changed_rules(head, law) == {"hosts", "new-rule"} and lawdiff.law_staged(str(root), law, head)
    assert lawdiff.message_stage(spark, law, head, "docs: x\n\nlaw-change: more hosts\n")["exit"] == 0
    refused = lawdiff.message_stage(spark, law, head, "feat: x\n")
    assert refused["exit"] == 5 and not refused["prefix"]["known"] and {f["rule"] for f in refused["findings"]} == {"law-relaxed"}
    with Bundle(spark, str(root)) as bundle:
        told = {(r.path, r.rule, r.severity) for r in lawtests.findings(spark, str(root), bundle.law, {"new-rule"}).collect()}
    assert ("bundle:rule-tests/gone", "rule-test-fails", "error") in told and ("bundle:constitution/types/field.yaml", "rule-untested", "error") in told and ("bundle:constitution/types/field.yaml", "rule-untested", "warning") in told
    assert {p for p, r, _ in told if r == "rule-test-fails"} >= {"bundle:rule-tests/hosts/negative.md"}  # the rule that no page can answer is drawn too


def test_pins_and_command_line(spark, root, tmp_path):
    run(root, "init", "-q")
    run(root, "add", "-A")
    run(root, "commit", "-qm", "docs: start")
    first = run(root, "rev-parse", "HEAD")
    (root / "src/a.txt").write_text("one\n")
    (root / "wiki/Pinned.md").write_text(f"---\ntype: field\npin: {{ commit: {first}, origin: ., covers: [src/] }}\n---\n\nSee `src/a.txt:2`, `:9` and `src/b.txt`.\n")
    (root / "wiki/Far.md").write_text(f"---\ntype: field\npin: {{ commit: {first}, origin: far, covers: [src] }}\n---\n\n[[Pinned]]\n")
    run(root, "add", "-A")
    run(root, "commit", "-qm", "docs: pins")
    with Bundle(spark, str(root)) as bundle:
        measured = bundle.pins().persist()
        pins = {r.path: r for r in measured.collect()}
        assert (pins["wiki/Pinned.md"].state, pins["wiki/Pinned.md"].touched, pins["wiki/Far.md"].reason) == ("stale", ["src/a.txt"], "remote-origin")
        assert {(u.path, u.line, u.reason) for u in pins["wiki/Pinned.md"].unresolved} == {("src/a.txt", 9, "past-end"), ("src/b.txt", None, "missing")}
        assert {(r.path, r.rule) for r in bundle.evidence_findings(measured).collect()} == {("wiki/Pinned.md", "pin-stale"), ("wiki/Pinned.md", "citation-unresolved"), ("wiki/Far.md", "pin-unmeasured"), ("wiki/Far.md", "stale-source-cited")}
        assert {r.state: r.pins for r in evidence.state_counts(measured).collect()} == {"current": 0, "unchanged": 0, "stale": 1, "unknown": 0, "unmeasured": 1} and {r.path: r.evaluated for r in evidence.page_cells(measured).collect()} == {"wiki/Pinned.md": True, "wiki/Far.md": False}
        measured.unpersist()
    assert cli.main(["type", "list", "--concrete", "--root", str(root), "--out", str(tmp_path / ".git/out.json")], spark) == 0 and len(json.loads((tmp_path / ".git/out.json").read_text())["data"]["types"]) == 2
    assert cli.main(["read", "Nothing", "--root", str(root)], spark) == 3 and cli.main(["rule", "try", "--type", "field", "--expr", "a ==", "--root", str(root)], spark) == 2 and cli.main(["gate", "--commit-msg", "no", "--root", str(root)], spark) == 3
    assert cli.main(["version"]) == 0 and git.root_names(str(root), "HEAD") == ["config", "constitution", "rule-tests", "shared", "src", "wiki"] and git.staged_text(str(root), "src/a.txt") == "one\n" and not git.checkout(str(root))[1]
    (root / "config/engine.json").write_text('{"label": "t", "content_roots": [".."], "more": 1}')
    assert cli.main(["check", "--root", str(root)], spark) == 2


def test_states(spark, tmp_path):
    (tmp_path / "wiki").mkdir()
    (tmp_path / "wiki/a.md").write_text("a")
    files = lambda: markdown.read_files(spark, str(tmp_path), ["wiki"])
    rows, _ = states.settled(files, spark)
    assert [(r.path, bytes(r.content)) for r in rows.collect()] == [("wiki/a.md", b"a")]
    calls = []

    def moving():
        calls.append(1)
        if len(calls) % 3 == 2:  # between the read and the second look at the stamps
            (tmp_path / "wiki/a.md").write_text("a" * (len(calls) + 1))
        return files()

    with pytest.raises(states.StateChanged):
        states.settled(moving, spark)
    at = os.stat(tmp_path / "wiki/a.md")

    def unstamped():
        calls.append(1)
        if len(calls) == 8:  # the same size and time, other bytes: told by its contents, as the stamp is too young
            (tmp_path / "wiki/a.md").write_text("b" * at.st_size)
            os.utime(tmp_path / "wiki/a.md", ns=(at.st_atime_ns, at.st_mtime_ns))
        return files()

    assert {bytes(r.content)[:1] for r in states.settled(unstamped, spark)[0].collect()} == {b"b"}
    disk = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("c", b"3")], "path string, content binary")
    drafts = spark.createDataFrame([("b", b"9"), ("d", b"3")], "path string, content binary")
    got = {r.path: (bytes(r.content), r.base_content and bytes(r.base_content), r.renamed_from) for r in states.overlay(disk, drafts, [("c", "d")]).collect()}
    assert got == {"a": (b"1", b"1", None), "b": (b"9", b"2", None), "d": (b"3", b"3", "c")}
    parsed = []
    parse = lambda rows: (parsed.append(rows.count()), rows.withColumn("body", F.decode("content", "UTF-8")).drop("content"))[1]
    for rows, n in ((disk, 3), (disk.union(drafts.filter("path = 'd'")), 1)):
        assert states.cached_pages(spark, rows, parse, str(tmp_path / "store"), "k").count() == rows.count() and parsed[-1] == n
    one = disk.filter("path = 'a'")
    for _ in range(2):  # most rows are of no use any more: a new generation holds the one that is
        assert [r.body for r in states.cached_pages(spark, one, parse, str(tmp_path / "store"), "k").collect()] == ["1"] and parsed[-1] == 0
    assert sorted(os.listdir(tmp_path / "store/k")) == ["rows-0001"]


def test_text_and_transitions(spark):
    one = lambda *cols, **given: tuple(spark.createDataFrame([tuple(given.values())], list(given)).select(*cols).first())
    a, b = F.col("a"), F.col("b")
    cases = [
        ("the valley floor holds water", "the valley floor holds watre", True), ("cat", "dog", False), ("a b", "a c", False), ("the pump is able to run", "the pump is unable to run", False), ("it is 3 metres deep now", "it is 4 metres deep now", False),
        ("never water the eastern beds", "now do water the eastern beds", False), ("水不深而且很清澈見底的樣子", "水深而且很清澈見底的樣子啊", False),
        ("a very long sentence about the meadow that lies behind the old stone barn and runs down to the river", "a very long sentence about the meadows that lie behind the old stone barn and runs down to the river", True),
    ]
    rows = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert [r.want for r in rows.collect()] == [r.c for r in rows.select(transitions.is_correction(a, b).alias("c")).collect()]
    base = spark.createDataFrame([("p", 1, "near", "A", "x.md"), ("p", 2, "near", "B", None)], "path string, pos int, label string, target string, resolved string")
    now = spark.createDataFrame([("p", 5, "near", "Other", "x.md")], base.schema)
    assert [r.pos for r in transitions.relations_removed(base, now).collect()] == [2]
    assert transitions.relations_removed(base, now, spark.createDataFrame([("p", "left: near [[ b #x|y]]")], "path string, text string")).count() == 0
    for path, want in (("C:/x\\y", "drive"), ("//s/x", "unc"), ("/x", "absolute"), ("a\\b", "backslash"), ("a\x01", "control-character"), ("a/", "trailing-slash"), ("a//b", "empty-segment"), ("a/./b", "dot-segment"), ("a/../b", "traversal"), ("", "empty"), ("a/.b/ü", None)):
        assert one(T.path_refusal(a), a=path) == (want,) and T.refused_path(path) == want
    assert one(T.supersede_clause(a, b), a="2025-03-01", b="#00000001") == ("valid →2025-02-28, superseded 2025-03-01 by #00000001",)
    assert T.canonical_json({"b": 1.0, "a": [1e21, 1e-7, 0.1, True, None], "é": "x"}) == '{"a":[1e+21,1e-7,0.1,true,null],"b":1,"é":"x"}'
    assert [T.satisfies("1.2.3", r) for r in ("^1.0.0", "~1.1.0", ">=1.2.0 <2.0.0", "x", "=1.2.3")] == [True, False, True, False, True]
    assert one(T.byte_spans(a), a="é\nab") == ([(1, 0, 2), (2, 3, 5)],) and one(T.pointer_key(a), a="/a~1b/0") == ("a/b",)
    body = "`src/a.py:3-5` `:9` `b.py` `x y` ``lib/z.py`` `:2` `README.md` `src/../x` `src/a.py:0` `dir/` `src/a.py:4-2` `two.md` `:7` `src/a.py` `:8` `src/` `:10`"
    covers = "array<struct<path:string,kind:string>>"
    read = spark.createDataFrame([("p", body, ["src", "lib"], [("src", "tree"), ("docs/b.py", "blob"), ("x/two.md", "blob"), ("y/two.md", "blob")]), ("q", "`:4` `src/a.py`", ["src"], [(".", "tree")])], f"path string, body string, top array<string>, covers {covers}")
    told = evidence.citations(evidence.spans(read, ["path", "top", "covers"]), ["path"]).collect()
    assert {(r.cited, r.line) for r in told if r.cited} == {("docs/b.py", None), ("src/a.py", 5), ("src/a.py", 9), ("src/a.py", None), ("src/a.py", 8), ("src/a.py", 10), ("src", None)}
    assert {(r.token, r.problem) for r in told if r.problem} == {("src/a.py:0", "malformed"), ("src/a.py:4-2", "malformed"), ("two.md", "ambiguous"), (":4", "unattached")} and sum(r.outside for r in told) == 5
    own = spark.createDataFrame([("a", False, None), ("b", True, "pin-stale"), ("c", None, "source-path-missing")], "path string, stale boolean, reason string")
    edges = spark.createDataFrame([("a", "b", "wikilink"), ("a", "c", "wikilink"), ("d", "c", "relation"), ("e", "b", "tagged")], "`from` string, `to` string, kind string")
    pages = spark.createDataFrame([(x,) for x in "abcde"], "path string")
    got = {r.path: (r.stale, r.reason) for r in evidence.page_status(pages, own, edges).collect()}
    assert got == {"a": (True, "stale-source-cited"), "b": (True, "pin-stale"), "c": (None, "source-path-missing"), "d": (None, "source-unverified-cited"), "e": (False, None)}
    assert git.parse_batch_check(b"aa blob 3\nbb missing\n") == [("aa", "blob", 3), ("bb", None, None)]
    listed = "path string, oid string, mode string"
    odd = git.disagreements(spark.createDataFrame([("a", "1", "m"), ("b", "2", "m")], listed), spark.createDataFrame([("a", "9", "m"), ("c", "3", "m")], listed), spark.createDataFrame([("a",), ("b",), ("x",)], "path string"))
    assert {(r.path, r.side) for r in odd.collect()} == {("c", "not-named"), ("x", "not-differing")}
    assert verdict.content_digest(spark.createDataFrame([("b", b"2"), ("a", b"1")], "path string, content binary")).first().digest == __import__("hashlib").sha256(b"".join(p + b"\0" + __import__("hashlib").sha256(c).hexdigest().encode() + b"\n" for p, c in ((b"a", b"1"), (b"b", b"2")))).hexdigest()
    assert cel.reads('before.present && page.x == "before"', "before") and not cel.reads('page.x == "before"', "before")

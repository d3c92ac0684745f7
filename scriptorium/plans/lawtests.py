"""Tests and examples that a law carries: all their pages are judged in one pass, each as if it stood alone in the bundle."""

from __future__ import annotations

import copy
import json
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import verdict
from scriptorium.plans import law as L

_KNOWN = {"expect.json", "negative.md", "repaired.md", "before/negative.md", "before/repaired.md"}


def read_expect(data: bytes) -> tuple[str, str | tuple[str, int]] | str:
    """(rule, "page" or (section, occurrence)) of an expect.json, or what is wrong with it."""
    try:
        value = json.loads(data.decode().removeprefix("﻿"))
    except ValueError as e:
        return f"not JSON: {e}"
    if not isinstance(value, dict) or not isinstance(value.get("rule"), str):
        return "an object with rule and location"
    if extra := sorted(set(value) - {"rule", "location"}):
        return "unknown keys: " + ", ".join(extra)
    at = value.get("location")
    if at == "page":
        return value["rule"], "page"
    if isinstance(at, dict) and set(at) == {"section", "occurrence"} and isinstance(at["section"], str) and type(at["occurrence"]) is int and at["occurrence"] >= 0:
        return value["rule"], (at["section"], at["occurrence"])
    return 'location is "page" or {"section": heading, "occurrence": n}'


def test_sets(law: L.Law) -> dict[tuple[str, str], dict[str, bytes]]:
    """(owner, rule) to the files of its test folder."""
    out: dict[tuple[str, str], dict[str, bytes]] = {}
    for (owner, path), data in sorted(law.files.items()):
        top, _, rest = path.partition("/")
        rule, _, name = rest.partition("/")
        if top == "rule-tests" and name:
            out.setdefault((owner, rule), {})[name] = data
    return out


test_sets.__test__ = False  # no test of ours, whatever its name


def judge(spark: SparkSession, root: str, law: L.Law, pages: dict[str, tuple[bytes, bytes | None]]) -> dict[str, list]:
    """Errors and warnings of each page (path to content and base); abstract types may have pages here, and nothing that concerns several pages counts."""
    from scriptorium.plans.bundle import Bundle

    own = copy.copy(law)
    own.types = {n: copy.replace(t, abstract=False) for n, t in law.types.items()}
    rows = [(p, bytearray(c), bytearray(b) if b is not None else None, None) for p, (c, b) in pages.items()]
    state = spark.createDataFrame(rows, "path string, content binary, base_content binary, renamed_from string")
    out: dict[str, list] = {p: [] for p in pages}
    with Bundle(spark, root, law=law) as vault, Bundle(spark, root, state, own, vault.sources, index=vault.names()) as tests:
        found = tests.findings().filter(F.col("severity") != "info").filter(~F.col("rule").isin(*verdict.VAULT_WIDE))
        for r in found.orderBy(*verdict.display_order()).collect():
            if r.path in out:
                out[r.path].append(r)
    return out


def findings(spark: SparkSession, root: str, law: L.Law, changed: set[str] = frozenset()) -> DataFrame:
    """rule-test-fails, rule-untested (an error for a rule that this change adds or changes) and example-fails."""
    sets, rules = test_sets(law), law.rules()
    pages: dict[str, tuple[bytes, bytes | None]] = {}
    for (owner, rule), files in sets.items():
        for name, data in files.items():
            if name in ("negative.md", "repaired.md") or (name.startswith("positive/") and name.endswith(".md")):
                pages[f"{owner}:rule-tests/{rule}/{name}"] = data, files.get(f"before/{name}")
    examples = {f"{o}:{p}": d for (o, p), d in law.files.items() if p.startswith("examples/") and p.endswith(".md")}
    pages |= {p: (d, None) for p, d in examples.items()}
    drawn = judge(spark, root, law, pages) if pages else {}
    rows: list[tuple] = []

    def tell(code: str, path: str, kind: str, message: str, severity: str = "error", **more) -> None:
        rows.append((path, code, severity, None, None, None, message, {"kind": kind, **more}))

    for (owner, rule), files in sets.items():
        at = f"{owner}:rule-tests/{rule}"
        if rule not in rules:
            tell("rule-test-fails", at, "rule-unknown", f"tests no rule of this law: {rule}")
            continue
        for name in files:
            if name not in _KNOWN and not (name.startswith("positive/") and "/" not in name[9:]):
                tell("rule-test-fails", f"{at}/{name}", "file-unknown", "is no part of a rule test", rule=rule)
        if "negative.md" in files:
            expect = read_expect(files["expect.json"]) if "expect.json" in files else "absent"
            if isinstance(expect, str) or expect[0] != rule:
                tell("rule-test-fails", f"{at}/expect.json", "expect-invalid", expect if isinstance(expect, str) else f"names rule {expect[0]}", rule=rule)
            else:
                found = drawn[f"{at}/negative.md"]
                place = lambda f: "page" if f.heading is None else (f.heading, f.occurrence or 0)
                if [(f.rule, place(f)) for f in found] != [expect]:
                    tell("rule-test-fails", f"{at}/negative.md", "negative", f"must draw exactly {expect}; it drew {[(f.rule, place(f)) for f in found]}", rule=rule)
        for name in files:
            if (name == "repaired.md" or name.startswith("positive/")) and (found := drawn.get(f"{at}/{name}")):
                tell("rule-test-fails", f"{at}/{name}", name.split("/")[0].removesuffix(".md"), f"must draw no finding; it drew {[f.rule for f in found]}", rule=rule)
    for rule, r in sorted(rules.items()):
        has = {n for (_, own), files in sets.items() if own == rule for n in files}
        lacks = [k for k, ok in (("negative", "negative.md" in has), ("repaired", "repaired.md" in has), ("positive", any(n.startswith("positive/") for n in has))) if not ok]
        if lacks:
            tell("rule-untested", r["where"], "untested", f"rule {rule} has no {', no '.join(lacks)} page", "error" if rule in changed else "warning", rule=rule)
    told: set[str] = set()
    for t in law.types.values():
        owner = t.about["prefix"].rstrip("/") or "bundle"
        for name in t.about.get("examples", []):
            path = f"{owner}:{posixpath.normpath(name)}"
            told.add(path)
            if path not in examples:
                tell("example-fails", path, "missing", f"{t.name} names an example that isn't there")
            elif f"type: {t.name}" not in examples[path].decode("utf-8", "replace"):
                tell("example-fails", path, "type", f"is an example of {t.name} and of another type")
    for path in examples:
        if drawn.get(path):
            tell("example-fails", path, "findings", f"must draw no finding; it drew {[f.rule for f in drawn[path]]}")
    frame = spark.createDataFrame(rows, "path string, rule string, severity string, line int, heading string, occurrence int, message string, details map<string,string>")
    routed = verdict.route(frame.withColumn("_s", F.col("severity")), verdict.routes(spark))
    return routed.withColumn("severity", F.when(F.col("rule") == "rule-untested", F.col("_s")).otherwise(F.col("severity"))).drop("_s")


def completeness(tests: DataFrame) -> DataFrame:
    """(rule, negative, repaired, positive) over all owners of test files (rule, name)."""
    name = F.col("name")
    return tests.groupBy("rule").agg(F.bool_or(name == "negative.md").alias("negative"), F.bool_or(name == "repaired.md").alias("repaired"), F.bool_or(name.startswith("positive/") & name.endswith(".md")).alias("positive"))

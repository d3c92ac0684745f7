"""Command line: one JSON envelope on standard output, an exit code for each kind of answer.

    python -m scriptorium.plans.cli check --root DIR
"""

from __future__ import annotations

import argparse
import json
import os
import sys

VERBS = {
    "check": "judge the bundle; --write renders generated files, --fix adds folder tags", "gate": "judge what is staged against HEAD, or a commit message", "write": "judge and land a folder of drafts and operations",
    "rule": "try a rule on a type before declaring it", "read": "read a page, a section, or what a budget holds", "search": "find pages, items or files", "type": "show or list the declared types", "graph": "edges between pages", "version": "the engine's version",
}
#: Exit codes.
EXITS = {"ok": 0, "internal": 1, "usage": 2, "constitution": 2, "not_found": 3, "conflict": 4, "findings": 5}
BOUND = 1 << 20


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="scriptorium")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *flags: str, **values) -> argparse.ArgumentParser:
        p = verbs.add_parser(name, help=VERBS[name])
        p.add_argument("--root", default=".")
        p.add_argument("--out")
        p.add_argument("--json", action="store_true")
        for f in flags:
            p.add_argument(f"--{f}", action="store_true")
        for k, v in values.items():
            p.add_argument(f"--{k.replace('_', '-')}", **v)
        return p

    capped = {"limit": {"type": int, "default": 100}, "rule": {}, "path": {}}
    verb("check", "write", "fix", "all", "summary", "dry-run", "tests", **capped)
    verb("gate", "all", "summary", **capped, commit_msg={})
    verb("write", "dry-run", **{"from": {"required": True}}, limit={"type": int, "default": 100})
    verb("rule", type={"required": True}, section={}, section_path={"nargs": "+"}, expr={"required": True}, config={}, base={}).add_argument("action", choices=["try"])
    verb("read", section={}, budget={"type": int}).add_argument("page")
    verb("search", "all", "near", "items", "files", "status", type={}, tag={}, title_contains={}, limit={"type": int, "default": 20}, band={"choices": ["identity", "relevance"]}).add_argument("query", nargs="?")
    shown = verb("type", "brief", "concrete")
    shown.add_argument("action", choices=["show", "list", "census"])
    shown.add_argument("name", nargs="?")
    verb("graph")
    verb("version")
    return top


def _check(bundle, a) -> dict:
    from scriptorium.plans import artifacts, writing

    written: list[str] = []
    if a.fix or a.write:
        fixed = writing.fix_folder_tags(bundle) if a.fix else {}
        if fixed and not a.dry_run:
            writing.land(bundle.root, fixed, [], {})
            from scriptorium.plans.bundle import Bundle

            bundle.close()
            bundle = Bundle(bundle.spark, bundle.root, law=bundle.law)
        files = artifacts.plans(bundle) if a.write else {}
        held = artifacts.held_digests(bundle.root)
        planned = {p: f for p, f in files.items() if held.get(p) != f.digest()}
        if planned and not a.dry_run:
            writing.land(bundle.root, planned, [], {})
        for f in files.values():
            f.drop()
        written = sorted({*fixed, *planned})
    limit = 0 if a.summary else None if a.all else a.limit
    has_files = os.path.isdir(os.path.join(bundle.root, "generated"))
    return bundle.check(limit, a.rule, a.path, generated=has_files and not a.dry_run, tests=a.tests) | {"written": written}


def _search(bundle, a) -> dict:
    if a.items or a.files:
        if a.query is None or a.near or a.band or (a.items and a.files):
            raise ValueError("--items and --files take a query, and neither each other nor --near nor --band")
        rows = bundle.search_items(a.query).orderBy(*_item_order()) if a.items else bundle.files(a.query).orderBy("path")
        rows = rows if a.all else rows.limit(a.limit)
        return {"items" if a.items else "files": [r.asDict() for r in rows.collect()]}
    if a.near and a.query is None:
        raise ValueError("--near takes a query")
    return bundle.search_report(a.query, 1 << 30 if a.all else a.limit, a.near, a.band, a.status, kind=a.type, tag=a.tag, title=a.title_contains)


def _item_order():
    from pyspark.sql import functions as F

    return F.desc("score"), F.col("path"), F.col("line")


def answer(a, spark) -> tuple[dict, str]:
    """(data, kind of exit) of a parsed command line."""
    from scriptorium import __version__

    if a.verb == "version":
        return {"version": __version__}, "ok"
    from scriptorium.plans import writing
    from scriptorium.plans.bundle import Bundle

    with Bundle(spark, a.root) as bundle:
        if a.verb == "check":
            out = _check(bundle, a)
        elif a.verb == "gate":
            message = None
            if a.commit_msg:
                path = a.commit_msg if os.path.isabs(a.commit_msg) else os.path.join(a.root, a.commit_msg)
                if not os.path.isfile(path):
                    return {"message": f"no commit message at {a.commit_msg}"}, "not_found"
                with open(path, encoding="utf-8") as f:
                    message = f.read()
            out = bundle.gate(0 if a.summary else None if a.all else a.limit, message, a.rule, a.path)
        elif a.verb == "write":
            out = writing.write(bundle, os.path.join(a.root, getattr(a, "from")), a.dry_run, limit=a.limit)
        elif a.verb == "rule":
            return bundle.try_rule(a.type, a.expr, a.section_path or a.section, json.loads(a.config) if a.config else None, a.base), "ok"
        elif a.verb == "read":
            return bundle.read(a.page, a.section, a.budget), "ok"
        elif a.verb == "search":
            return _search(bundle, a), "ok"
        elif a.verb == "type":
            if a.action == "census":
                return {"census": [r.asDict() for r in bundle.census().collect()]}, "ok"
            found = bundle.types(a.name, a.concrete, a.brief)
            return {"types": found}, "ok" if found or a.name is None else "not_found"
        else:
            return {"edges": [r.asDict() for r in bundle.graph().orderBy("from", "to", "kind", "label").collect()]}, "ok"
    return out, "findings" if out.get("exit") else "ok"


def main(argv: list[str] | None = None, spark=None) -> int:
    from pyspark.sql import SparkSession

    from scriptorium.functions.cel import RuleRefused
    from scriptorium.plans.law import LawRefused
    from scriptorium.plans.reading import NotFound
    from scriptorium.plans.writing import Refused

    a = parser().parse_args(argv)
    if a.verb != "version":
        spark = spark or SparkSession.builder.getOrCreate()
    try:
        data, kind = answer(a, spark)
    except Refused as e:
        data, kind = {"code": e.code, "message": str(e), **e.details}, e.kind
    except LawRefused as e:
        data, kind = {"issues": [{"code": c, "where": w, "message": m} for c, w, m in e.issues]}, "constitution"
    except NotFound as e:
        data, kind = {"message": str(e)}, "not_found"
    except (RuleRefused, ValueError, KeyError) as e:
        data, kind = {"message": str(e)}, "usage"
    text = json.dumps({"verb": a.verb, "ok": kind == "ok", "kind": kind, "data": data}, ensure_ascii=False, default=str)
    if a.out:
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(text + "\n")
        text = json.dumps({"verb": a.verb, "ok": kind == "ok", "kind": kind, "out": a.out})
    elif len(text.encode()) > BOUND:
        text, kind = json.dumps({"verb": a.verb, "ok": False, "kind": "usage", "data": {"message": f"the answer has more than {BOUND} bytes: narrow it, or name a file with --out"}}), "usage"
    print(text)
    return EXITS[kind]


if __name__ == "__main__":
    sys.exit(main())

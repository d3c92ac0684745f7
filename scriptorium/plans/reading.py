"""Reading one page: by path, name, alias or title; whole, one section, or what a budget of bytes holds."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.sources import markdown


class NotFound(LookupError):
    pass


def cut(raw: str, headings: list[tuple[str, int]], path: str) -> list[dict]:
    """The lead and one verbatim piece per heading (text, line), line ends kept; repeated headings are numbered from 1."""
    lines = _lines(raw.removeprefix("\ufeff"))
    bare = [x.rstrip("\r\n") for x in lines]
    first = next((k + 2 for k in range(1, len(bare)) if bare[k] == "---"), 1) if bare[:1] == ["---"] else 1
    starts = [line for _, line in headings] + [len(lines) + 1]
    pieces = ([(None, first, starts[0] - 1)] if starts[0] - 1 >= first else []) + [(h, line, starts[k + 1] - 1) for k, (h, line) in enumerate(headings)]
    keys = [T.fold(h) if h is not None else None for h, _, _ in pieces]
    out = []
    for k, (h, line, end) in enumerate(pieces):
        text = "".join(lines[line - 1 : end])
        row = {"heading": h, "address": path if h is None else f"{path}#{h}", "line": line, "end_line": end, "bytes": len(text.encode()), "text": text}
        if h is not None and keys.count(keys[k]) > 1:
            row["occurrence"] = keys[: k + 1].count(keys[k])
        out.append(row)
    return out


def _lines(text: str) -> list[str]:
    out = text.split("\n")
    return [x + "\n" for x in out[:-1]] + ([out[-1]] if out[-1] else [])


def within(pieces: list[dict], budget: int | None) -> tuple[list[dict], list[dict]]:
    """(pieces that fit, the rest without text): once one doesn't fit, all later ones are left out."""
    used = 0
    for k, p in enumerate(pieces):
        if budget is not None and used + p["bytes"] > budget:
            return pieces[:k], [{n: v for n, v in x.items() if n != "text"} | {"reason": "budget"} for x in pieces[k:]]
        used += p["bytes"]
    return pieces, []


def resolve(bundle, wanted: str) -> tuple[str, str]:
    """(path, how) of the page that a path, name, alias or title stands for; the smallest path of a shared title."""
    pages = bundle.pages()
    if pages.filter(F.col("path") == wanted).limit(1).count():
        return wanted, "path"
    key = T.fold(wanted.strip())
    hit = bundle.names().filter(F.col("ident") == key).first()
    if hit:
        return hit.target, "alias" if hit.via_alias else "name"
    shown = F.coalesce("title", T.basename(F.col("path"))) if bundle.law.title_is_name else F.col("title")
    hit = bundle.readable().filter(T.ident(shown) == T.fold(wanted)).agg(F.min("path").alias("path")).first()
    if hit.path is None:
        raise NotFound(f"no page answers to {wanted}")
    return hit.path, "title"


def read(bundle, wanted: str, section: str | None = None, budget: int | None = None) -> dict:
    """One page: what it is, its pieces, its sections' modes and spans, what a budget left out, its freshness."""
    from scriptorium.plans import artifacts

    path, how = resolve(bundle, wanted)
    content = bytes(bundle.state.filter(F.col("path") == path).first().content)
    raw = content.decode("utf-8", "replace")
    page = markdown.parse_page(path, content, bundle.source_roots, {t.name: t.depth for t in bundle.law.types.values()})
    kind = bundle.law.types.get(page.get("type"))
    depth = kind.depth if kind else 2
    pieces = cut(raw, [(s["heading"], s["line"]) for s in page["sections"] if s["depth"] == depth], path)
    chosen = pieces
    if section is not None:
        chosen = [p for p in pieces if p["heading"] is not None and T.fold(p["heading"]) == T.fold(section)]
        if not chosen:
            raise NotFound(f"{path} has no section {section}; it has " + ", ".join(p["heading"] for p in pieces if p["heading"]))
    kept, omitted = within(chosen, budget)
    own = bundle.typed().filter(F.col("path") == path).filter("declared is not null")
    regions = [r.asDict() for r in bundle.sections(own).select("heading", "occurrence", "depth", "section_path", F.col("policy.path").alias("policy"), "mode", "explicit", "line").orderBy("line").collect()]
    rules, why = artifacts.unresolved(bundle, path)
    fresh = bundle.statuses().filter(F.col("path") == path).first()
    about = {
        "path": path, "name": path.rpartition("/")[2].removesuffix(".md"), "resolved_via": how, "type": page.get("type"), "role": kind.role if kind else None, "ancestry": kind.ancestry if kind else [], "title": page.get("title"), "description": page.get("description"),
        "status": "retired" if page.get("status") == "retired" else "active", "frontmatter": json.loads(page.get("frontmatter") or "{}"),
    }
    return {
        "page": about, "bytes": hashlib.sha256(content).hexdigest(), "sections": kept, "regions": regions, "unbound_preamble": bool(page["preamble"].strip()), "omitted": omitted,
        "status": {"stale": fresh.stale if fresh else None, "reason": fresh.reason if fresh else None, "unresolved": rules, "unresolved_reason": why},
        "coverage": {"sections": len(pieces), "returned": len(kept), "bytes_returned": sum(p["bytes"] for p in kept), "budget": budget},
    }

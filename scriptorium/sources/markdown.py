"""Markdown pages to rows: frontmatter, sections, items, links.

One Arrow function reads a page's bytes once and gives a nested row; all later
operators are columns. Headings count at document level only, not inside quotes and
list items; fences and HTML blocks are opaque, and an item is a list line at most three spaces
deep whose deeper lines are its rationale. Every item is read by the three record
grammars; the law's section decides which reading holds.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import itertools
import json
import os
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import fold
from scriptorium.sources.yamlcore import YamlRefused, read_yaml

#: Bytes of a page; sections, items of a section, members of a frontmatter list, links.
PAGE_BYTES, SECTIONS, ITEMS, LIST, LINKS = 1 << 20, 200, 5000, 1000, 10_000
#: Pages and bytes that are held as nested rows at a time.
HELD_PAGES, HELD_BYTES = 128, 1 << 20

_FENCE = re.compile(r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_BULLET = re.compile(r"^ {0,3}(?:[-*+]|[0-9]{1,9}[.)])(?:[ \t]+|$)")
_THEMATIC = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
#: How the seven kinds of HTML blocks begin and end (the CommonMark specification, 4.6); None ends at a blank line.
_BLOCK_TAGS = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul".split()
_TAG = r"<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][A-Za-z0-9_.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"
_HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)), (re.compile(r"<!--"), re.compile(r"-->")), (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")), (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")), (re.compile(rf"</?(?:{'|'.join(_BLOCK_TAGS)})(?:\s|/?>|$)", re.I), None), (re.compile(rf"(?:{_TAG})\s*$"), None),
]
_QUOTE = re.compile(r" {0,3}>[ \t]?")
_ITEM = re.compile(r"( {0,3})([-*+]|[0-9]{1,9}[.)])(?=[ \t]|$)")
_LINK = re.compile(r"(?<!\\)\[\[([^\[\]|#\n]+?)(?:#([^\[\]|\n]*?))?(?:\|([^\[\]\n]*?))?\]\]")
_CODE = re.compile(r"(?<!`)(`+)(?!`)(.*?)(?<!`)\1(?!`)", re.S)
_CLAIM = re.compile(r"^- \[([a-z0-9]+(?:-[a-z0-9]+)*)\] (.+)$")
_RELATION = re.compile(r"^- ([^\[\]]+?) \[\[([^\[\]|#]+?)(?:#([^\[\]|]*?))?(?:\|([^\[\]]*?))?\]\]\s*$")
_ENTRY = re.compile(r"^- ([0-9]{4}(?:-[0-9]{2}(?:-[0-9]{2})?)?) — (.+)$")
_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_LIFE = re.compile(rf"^(?:retracted ({_DAY})|superseded ({_DAY})(?: by (#[0-9a-f]{{8}}))?|valid (?:from ({_DAY}))?(?: ?(?:to|until) ({_DAY}))?)$")


def _tail(text: str):
    """(rest, inside) of a balanced parenthesis at the end."""
    if not text.endswith(")"):
        return text, None
    depth = 0
    for k in range(len(text) - 1, -1, -1):
        depth += (text[k] == ")") - (text[k] == "(")
        if depth == 0:
            return (text[: k - 1], text[k + 1 : -1]) if k and text[k - 1] == " " and text[k + 1 : -1] else (text, None)
    return text, None


def _date(text: str) -> str | None:
    """Precision of a partial date, None if it isn't one."""
    try:
        parts = [int(x) for x in text.split("-")]
        datetime.date(max(parts[0], 4), *(parts[1:] + [1, 1])[:2])
        return ("year", "month", "day")[len(parts) - 1]
    except ValueError:
        return None


def parse_claim(line: str, roots: tuple = ()) -> dict | None:
    m = _CLAIM.match(line)
    if not m:
        return None
    core, out = m[2].rstrip(), {"category": m[1], "prov_kind": "none"}
    rest, inside = _tail(core)
    if inside is not None and (life := _LIFE.match(inside)):
        out |= dict(zip(("retracted", "superseded", "superseded_by", "valid_from", "valid_to"), life.groups()))
        core, (rest, inside) = rest, _tail(rest)
    if inside is not None:
        link = _LINK.fullmatch(inside)
        if link:
            out |= {"prov_kind": "page", "prov_value": link[1].strip()}
        elif re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://\S+$", inside):
            out |= {"prov_kind": "url", "prov_value": inside}
        elif any(inside == r or inside.startswith(r + "/") for r in roots):
            out |= {"prov_kind": "path", "prov_value": inside}
        else:
            rest = core
        core = rest
    return out | {"core": core} if core.strip() else None


def parse_relation(line: str) -> dict | None:
    m = _RELATION.match(line)
    return {"label": m[1].strip(), "target_name": m[2].strip(), "target_heading": m[3], "target_alias": m[4]} if m else None


def parse_entry(line: str) -> dict | None:
    m = _ENTRY.match(line)
    return {"date": m[1], "precision": _date(m[1]), "text": m[2].strip()} if m and _date(m[1]) else None


def _keyed_claim(claim: dict | None) -> dict | None:
    """A claim with its handle, the identity key of the page or the folder-free path that it cites, and whether it is closed."""
    if claim is None:
        return None
    value = claim.get("prov_value")
    key = fold(value) if claim["prov_kind"] == "page" else unicodedata.normalize("NFC", value.removesuffix("/")) if claim["prov_kind"] == "path" else None
    return claim | {"handle": "#" + hashlib.sha256(fold(claim["core"]).encode()).hexdigest()[:8], "prov_key": key, "closed": bool(claim.get("retracted") or claim.get("superseded"))}


def _keyed_relation(relation: dict | None) -> dict | None:
    return relation and relation | {"ident": fold(relation["target_name"]), "label_ident": fold(relation["label"])}


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _too_long(value, at: str = "") -> str | None:
    """Pointer of the first list or mapping of a frontmatter with too many members."""
    if isinstance(value, (list, dict)):
        if at and len(value) > LIST:
            return at
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            if found := _too_long(v, f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}"):
                return found
    return None


def blocks(lines: list[str], start: int = 0) -> tuple[list[tuple[int, int, str]], set[int], set[int]]:
    """(headings, opaque, code) of a page: (line, depth, text) of the document's own headings, lines of fences and HTML at any depth, of indented code.

    A line goes through the containers that are open, quotes and list items, as far as it continues them; the rest of it
    belongs to the innermost. A paragraph takes lines that don't continue its containers if they start nothing. What
    stands in a container is content of it, so its headings aren't told.
    """
    headings, opaque, code = [], set(), set()
    stack: list[int | None] = []  # None: a quote; a number: the column where an item's content starts
    leaf, leaf_end, paragraph = "blank", None, start  # blank, paragraph, fence, html or code; what ends a fence or HTML; where the paragraph began
    for k in range(start, len(lines)):
        rest, held = lines[k].expandtabs(4) if "\t" in lines[k] else lines[k], 0
        for box in stack:
            if box is None:
                m = _QUOTE.match(rest)
                if not m:
                    break
                rest = rest[m.end() :]
            elif rest.strip() == "":
                rest = ""
            elif len(rest) - len(rest.lstrip(" ")) >= box:
                rest = rest[box:]
            else:
                break
            held += 1
        whole = held == len(stack)
        if not whole and leaf in ("fence", "html", "code"):
            leaf = "blank"
        if leaf == "fence":
            opaque.add(k)
            m = _FENCE.match(rest)
            if m and m[1][0] == leaf_end[0] and len(m[1]) >= len(leaf_end) and not rest.strip().strip(leaf_end[0]):
                leaf = "blank"
            continue
        if leaf == "html":
            if leaf_end is None and not rest.strip():
                leaf = "blank"
                continue
            opaque.add(k)
            if leaf_end is not None and leaf_end.search(rest):
                leaf = "blank"
            continue
        lazy, opened = leaf == "paragraph" and not whole, False
        while True:  # containers that the line opens
            if m := _QUOTE.match(rest):
                box, rest = None, rest[m.end() :]
            elif (m := _ITEM.match(rest)) and not _THEMATIC.match(rest) and (leaf != "paragraph" or opened or held < len(stack) or (rest[m.end() :].strip() and m[2] in ("-", "*", "+", "1.", "1)")) or any(x is not None for x in stack)):
                after = rest[m.end() :]
                gap = len(after) - len(after.lstrip(" "))
                gap = gap if after.strip() and 1 <= gap <= 4 else 1
                box, rest = m.end() + gap, after[gap:] if after.strip() else ""
            else:
                break
            stack[held:] = [box]
            held, opened, lazy, leaf = held + 1, True, False, "blank"
        if not rest.strip():
            if not opened:
                stack[held:] = []  # a blank line ends the quotes that it doesn't continue
            leaf = "blank" if leaf != "code" else leaf
            continue
        indent = len(rest) - len(rest.lstrip(" "))
        fence, atx, text = _FENCE.match(rest), _HEADING.match(rest), rest.lstrip(" ")
        html = None if indent > 3 else next((n for n, (begin, _) in enumerate(_HTML) if begin.match(text) and (n < 6 or leaf != "paragraph")), None)
        starts = fence or atx or html is not None or _THEMATIC.match(rest)
        if lazy and not starts:
            continue  # the paragraph goes on, its containers with it
        if held < len(stack):
            stack[held:], leaf = [], "blank"
        if indent > 3 and leaf != "paragraph":
            leaf = "code"
            code.add(k)
        elif fence:
            leaf, leaf_end = "fence", fence[1]
            opaque.add(k)
        elif html is not None:
            leaf_end = _HTML[html][1]
            opaque.add(k)
            leaf = "blank" if leaf_end is not None and leaf_end.search(text, 2) else "html"
        elif atx:
            leaf = "blank"
            if not stack:
                headings.append((k, len(atx[1]), (atx[2] or "").strip()))
        elif leaf == "paragraph" and (m := _SETEXT.match(rest)):
            leaf = "blank"
            if not stack:
                headings.append((paragraph, 1 if m[1][0] == "=" else 2, " ".join(x.strip() for x in lines[paragraph:k])))
        elif _THEMATIC.match(rest):
            leaf = "blank"
        else:
            if leaf != "paragraph":
                paragraph = k
            leaf = "paragraph"
    return headings, opaque, code


def parse_page(path: str, content: bytes, roots: tuple = (), depths: dict | None = None) -> dict:
    """The nested row of one page; ``code`` is set when it can't be read. ``depths``: type to the depth of its sections, 2 for others."""
    page = {"path": path, "code": None, "code_line": None, "message": None, "sections": [], "items": [], "links": [], "tags": [], "aliases": [], "headings": [], "preamble": "", "has_preamble": False}
    if len(content) > PAGE_BYTES:
        return page | {"code": "page-too-large", "message": "bytes"}
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        return page | {"code": "page-not-utf8"}
    text = text.removeprefix("﻿").replace("\r\n", "\n")
    lines = text.split("\n")
    start, front, key_lines = 0, {}, {}
    if lines[0] == "---":
        end = next((k for k in range(1, len(lines)) if lines[k].rstrip() == "---"), None)
        if end is None:
            return page | {"code": "malformed-frontmatter", "code_line": 1, "message": "not closed"}
        start = end + 1
        try:
            front, key_lines = read_yaml("\n".join(lines[1:end]))
            if front is None:
                front = {}
            if not isinstance(front, dict):
                return page | {"code": "frontmatter-not-mapping", "code_line": 1}
        except YamlRefused as e:
            return page | {"code": e.code, "code_line": e.line + 1, "message": str(e)}
        if at := _too_long(front):
            return page | {"code": "page-too-large", "message": f"list {at}"}
    depth = (depths or {}).get(front.get("type") if isinstance(front.get("type"), str) else None, 2)
    texts = lambda v: [x for x in v if isinstance(x, str)] if isinstance(v, list) else []
    word = lambda k: front[k] if isinstance(front.get(k), str) else None
    page |= {
        "type": word("type"), "title": word("title"), "description": word("description"), "status": word("status"), "tags": texts(front.get("tags")), "aliases": texts(front.get("aliases")),
        "frontmatter": json.dumps(front, ensure_ascii=False, sort_keys=True, default=str), "key_lines": {str(k): v + 1 for k, v in key_lines.items()}, "body": "\n".join(lines[start:]),
    }

    headings, opaque, code = blocks(lines, start)
    if len(headings) > SECTIONS:
        return page | {"code": "page-too-large", "message": "sections"}

    shown = "\n".join(_blank(x) if i < start or i in opaque or i in code else x for i, x in enumerate(lines))
    shown = _CODE.sub(lambda m: _blank(m[0]), shown)
    ends = [m.start() for m in re.finditer("\n", shown)]
    for m in _LINK.finditer(shown):
        page["links"].append({"target": m[1].strip(), "ident": fold(m[1].strip()), "heading": m[2], "alias": m[3], "line": bisect.bisect_left(ends, m.start()) + 1})
    if len({x["target"] for x in page["links"]}) > LINKS:
        return page | {"code": "page-too-large", "message": "links"}

    starts = [0, *itertools.accumulate(len(x.encode()) + 1 for x in lines)]  # byte at which each line begins

    def written(first: int, after: int) -> tuple[str, list[int]]:
        """Text and byte span of lines up to the last one that isn't blank, the first in any case."""
        while after - 1 > first and not lines[after - 1].strip():
            after -= 1
        return "\n".join(lines[first:after]), [starts[first], starts[after] - 1]

    page["headings"] = [t for _, _, t in headings]
    first = headings[0][0] if headings else len(lines)
    page["preamble"] = "\n".join(lines[start:first]).strip("\n")
    stack: list[tuple] = []
    siblings: dict = {}
    for n, (at, level, title) in enumerate(headings):
        while stack and stack[-1][0] >= level:
            stack.pop()
        parent = tuple(x[2] for x in stack)
        index = siblings.get((parent, title), 0)
        siblings[parent, title] = index + 1
        address = f"{title}#{index}"
        stack.append((level, title, address))
        deeper = next((a for a, l, _ in headings[n + 1 :] if l <= level), len(lines))
        direct = headings[n + 1][0] if n + 1 < len(headings) else len(lines)
        page["sections"].append({"seq": n, "occurrence": sum(t == title for _, _, t in headings[:n]), "heading": title, "depth": level, "heading_path": [x[1] for x in stack], "section_path": [x[1] for x in stack if x[0] >= depth], "address": "/".join([*parent, address]), "line": at + 1, **dict(zip(("raw", "span"), written(at, deeper))), **dict(zip(("direct", "direct_span"), written(at, direct)))})
        page["items"] += _items(lines, at + 1, direct, opaque, n, roots, starts)
        if sum(x["seq"] == n for x in page["items"][-ITEMS - 1 :]) > ITEMS:
            return page | {"code": "page-too-large", "message": "items"}
    return page


def _items(lines, start, end, opaque, seq, roots, starts) -> list[dict]:
    out, now = [], None
    for k in range(start, end):
        line = lines[k]
        if k in opaque:
            if now is not None and not line.startswith("  "):
                now = None
            continue
        if not _THEMATIC.match(line) and _BULLET.match(line):
            raw = re.sub(r"^ {0,3}(?:[*+]|[0-9]{1,9}[.)])\s+", "- ", line.strip())
            now = {"seq": seq, "pos": len(out), "line": k + 1, "raw": raw, "rationale": [], "span": [starts[k], starts[k + 1] - 1]}
            now |= {"claim": _keyed_claim(parse_claim(raw, roots)), "relation": _keyed_relation(parse_relation(raw)), "entry": parse_entry(raw)}
            out.append(now)
        elif line.startswith((" ", "\t")) and line.strip() and now is not None:
            now["rationale"].append(line.strip())
            now["span"][1] = starts[k + 1] - 1
        elif line.strip():
            now = None
    return out


_CLAIM_T = "struct<category: string, core: string, prov_kind: string, prov_value: string, retracted: string, superseded: string, superseded_by: string, valid_from: string, valid_to: string, handle: string, prov_key: string, closed: boolean>"
_REL_T = "struct<label: string, target_name: string, target_heading: string, target_alias: string, ident: string, label_ident: string>"
_ENTRY_T = "struct<date: string, precision: string, text: string>"
PAGE = (
    "path string, code string, code_line int, message string, type string, title string, description string, status string, tags array<string>, aliases array<string>, headings array<string>, "
    "frontmatter string, key_lines map<string, int>, body string, preamble string, "
    "sections array<struct<seq: int, occurrence: int, heading: string, depth: int, heading_path: array<string>, section_path: array<string>, address: string, line: int, raw: string, span: array<long>, direct: string, direct_span: array<long>>>, "
    f"items array<struct<seq: int, pos: int, line: int, raw: string, rationale: array<string>, span: array<long>, claim: {_CLAIM_T}, relation: {_REL_T}, entry: {_ENTRY_T}>>, "
    "links array<struct<target: string, ident: string, heading: string, alias: string, line: int>>"
)


def read_files(spark: SparkSession, root: str, content_roots: list[str]) -> DataFrame:
    """(path, content, modificationTime, length) of every .md file under the content roots, by Spark's own reader; stamps alone read no contents."""
    paths = [f"{root.rstrip('/')}/{r}" for r in content_roots]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(paths)
    plain = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"^[a-z]+:/*", "/")
    inside = F.length(F.lit(root.rstrip("/"))) + 2
    return files.select(F.substring(plain, inside, F.length("path")).alias("path"), "content", "modificationTime", "length")


def walk(root: str, content_roots: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """(paths of pages, skipped (path, reason)): links are never followed, folders that hold a repository never entered."""
    pages, skipped = [], []
    for top in content_roots:
        for at, folders, names in os.walk(os.path.join(root, top)):
            inside = os.path.relpath(at, root)
            for n in list(folders):
                full = os.path.join(at, n)
                if os.path.islink(full) or os.path.exists(os.path.join(full, ".git")):
                    folders.remove(n)
                    skipped.append((f"{inside}/{n}", "link" if os.path.islink(full) else "repository"))
            for n in names:
                if os.path.islink(os.path.join(at, n)):
                    if n.endswith(".md"):
                        skipped.append((f"{inside}/{n}", "link"))
                elif n.endswith(".md"):
                    pages.append(f"{inside}/{n}")
    return sorted(unicodedata.normalize("NFC", p) for p in pages), sorted(skipped)


def without(files: DataFrame, skipped: DataFrame) -> DataFrame:
    """Files (path, ...) that neither are nor lie below a skipped path (at)."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hidden = files.select("path", F.explode(prefixes).alias("at")).join(skipped.select("at"), "at", "left_semi").select("path").distinct()
    return files.join(hidden, "path", "left_anti")


def _parts(contents) -> Iterator[slice]:
    """Slices of a batch, in order: at most HELD_PAGES pages, and no more than HELD_BYTES unless one page alone has them. Nested rows take many times the bytes of their pages."""
    start, held = 0, 0
    for k, c in enumerate(contents):
        size = len(c or b"")
        if k > start and (k - start == HELD_PAGES or held + size > HELD_BYTES):
            yield slice(start, k)
            start, held = k, 0
        held += size
    if len(contents):
        yield slice(start, len(contents))


def parse(files: DataFrame, source_roots: tuple = (), depths: dict | None = None) -> DataFrame:
    """Nested rows (PAGE) of (path, content)."""

    def run(frames):
        import pandas as pd

        names = re.findall(r"(?:^|, )([a-z_]+) (?=string|int|array|map)", PAGE)
        for f in frames:
            for part in _parts(f["content"]):
                rows = [parse_page(p, bytes(c or b""), source_roots, depths) for p, c in zip(f["path"][part], f["content"][part])]
                yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names).astype({"code_line": "Int32"})

    return files.select("path", "content").mapInPandas(run, PAGE)


def sections(pages: DataFrame) -> DataFrame:
    return pages.select("path", "type", F.inline("sections"))


def items(pages: DataFrame) -> DataFrame:
    """Items with the heading and address of their section."""
    rows = pages.select("path", "type", "sections", F.explode("items").alias("i"))
    own = F.get(F.col("sections"), F.col("i.seq"))
    return rows.select("path", "type", *(own[c].alias(c) for c in ("heading", "occurrence", "address", "section_path")), "i.*")


def links(pages: DataFrame) -> DataFrame:
    return pages.select("path", F.inline("links")).withColumnRenamed("target", "target_name")

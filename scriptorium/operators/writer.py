"""Splices into pages: set or remove a field, append to a list, append under or replace a section, rename links.

Operations are rows (path, seq, op, key, value); all of a page's operations are applied
to its text in one grouped call, its byte order mark and line ends stay, and a page whose operations
clash or don't apply is refused whole.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import fold

_PLAIN = re.compile(r"^[A-Za-z_][A-Za-z0-9_ ./-]*$")
_WORDS = {"true", "false", "null", "yes", "no", "on", "off", "y", "n", "~"}


class SpliceRefused(ValueError):
    pass


def yaml_scalar(value: str) -> str:
    """Plain where that reads back as the same text, else in JSON quotes."""
    plain = _PLAIN.match(value) and value.lower() not in _WORDS and value == value.strip()
    return value if plain else json.dumps(value, ensure_ascii=False)


def rename_links(text: str, old: str, new: str) -> tuple[str, int]:
    """[[old...]] to [[new...]] by identity key; heading and alias stay."""
    count = 0

    def swap(m):
        nonlocal count
        if fold(m[1].strip()) != fold(old.strip()):
            return m[0]
        count += 1
        return f"[[{new}{m[2]}]]"

    return re.sub(r"(?<!\\)\[\[([^\[\]|#\n]+)((?:#[^\[\]|\n]*)?(?:\|[^\[\]\n]*)?)\]\]", swap, text), count


def close_line(text: str, line: int, clause: str) -> str:
    """`` (clause)`` at the end of a 1-based line."""
    lines = text.split("\n")
    if not 1 <= line <= len(lines):
        raise SpliceRefused(f"no line {line}")
    own = lines[line - 1].rstrip("\r")
    lines[line - 1] = f"{own.rstrip()} ({clause})" + lines[line - 1][len(own) :]
    return "\n".join(lines)


def _front(lines: list[str]) -> int:
    """Index of the closing fence of the frontmatter."""
    if lines[0] == "---":
        for k in range(1, len(lines)):
            if lines[k].rstrip() == "---":
                return k
    raise SpliceRefused("no frontmatter")


def _span(lines: list[str], key: str) -> tuple[int, int] | None:
    end = _front(lines)
    for k in range(1, end):
        if re.match(rf"^{re.escape(key)}\s*:", lines[k]):
            stop = k + 1
            while stop < end and (lines[stop].startswith((" ", "\t", "- ")) or lines[stop] == "-"):
                stop += 1
            return k, stop
    return None


def _set(lines, key, value):
    at = _span(lines, key)
    new = [f"{key}: {yaml_scalar(value)}"]
    if at:
        lines[at[0] : at[1]] = new
    else:
        lines[(end := _front(lines)) : end] = new


def _remove(lines, key, _):
    at = _span(lines, key)
    if not at:
        raise SpliceRefused(f"no field {key}")
    del lines[at[0] : at[1]]


def _append(lines, key, value):
    from scriptorium.sources.yamlcore import read_yaml

    at = _span(lines, key)
    if not at:
        lines[(end := _front(lines)) : end] = [f"{key}: [{yaml_scalar(value)}]"]
        return
    held = read_yaml("\n".join(lines[at[0] : at[1]]))[0][key]
    if not isinstance(held, list):
        raise SpliceRefused(f"{key} isn't a list")
    if value in held:
        return
    if at[1] - at[0] == 1:
        lines[at[0]] = re.sub(r"\s*\]\s*$", (", " if held else "") + yaml_scalar(value) + "]", lines[at[0]])
    else:
        indent = re.match(r"\s*", lines[at[1] - 1])[0]
        lines[at[1] : at[1]] = [f"{indent}- {yaml_scalar(value)}"]


def _section(lines, key) -> tuple[int, int]:
    from scriptorium.sources.markdown import parse_page

    found = parse_page("", "\n".join(lines).encode())["sections"]
    own = [s for s in found if s["heading"] == key]
    if len(own) != 1:
        raise SpliceRefused(f"{len(own)} sections {key}")
    after = [s["line"] for s in found if s["line"] > own[0]["line"] and s["depth"] <= own[0]["depth"]]
    end = min(after) - 1 if after else len(lines)
    while end > own[0]["line"] and not lines[end - 1].strip():
        end -= 1
    return own[0]["line"], end


def _under(lines, key, value):
    start, end = _section(lines, key)
    gap = [""] if end == start or not re.match(r"^\s*([-*+]|\d+[.)])\s", lines[end - 1]) else []
    lines[end:end] = gap + value.split("\n")


def _replace(lines, key, value):
    start, end = _section(lines, key)
    lines[start:end] = ["", *value.split("\n")]


_OPS = {"set": _set, "remove": _remove, "append": _append, "under": _under, "replace": _replace}


def splice(text: str, ops: list[tuple[str, str, str]]) -> str:
    """The page after (op, key, value) in order; SpliceRefused if two name the same field or section, or one doesn't apply."""
    seen = set()
    for op, key, _ in ops:
        if op in ("set", "remove", "replace") and (op == "replace", key) in seen:
            raise SpliceRefused(f"two operations on {key}")
        seen.add((op in ("replace", "under"), key))
    mark = "﻿" if text.startswith("﻿") else ""
    crlf = "\r\n" in text
    lines = text.removeprefix("﻿").replace("\r\n", "\n").split("\n")
    for op, key, value in ops:
        if op == "rename":
            lines = rename_links("\n".join(lines), key, value)[0].split("\n")
        elif op in _OPS:
            _OPS[op](lines, key, value)
        else:
            raise SpliceRefused(f"unknown operation {op}")
    return mark + "\n".join(lines).replace("\n", "\r\n" if crlf else "\n")


def apply(pages: DataFrame, ops: DataFrame) -> DataFrame:
    """(path, text, refused) of the pages (path, text) that have operations (path, seq, op, key, value)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for path, text, own in zip(*(batch[c].to_pylist() for c in ("path", "text", "ops")), strict=True):
                if text is None:
                    out.append((path, None, "no such page"))
                    continue
                try:
                    out.append((path, splice(text, [(o["op"], o["key"], o["value"]) for o in own]), None))
                except SpliceRefused as e:
                    out.append((path, text, str(e)))
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["path", "text", "refused"])

    # a page has as many operations as its author wrote; the rows stay in Arrow batches, no group a page
    listed = ops.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "key", "value"))).alias("ops"))
    return listed.join(pages.select("path", "text"), "path", "left").select("path", "text", "ops").mapInArrow(run, "path string, text string, refused string")

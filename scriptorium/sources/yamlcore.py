"""YAML 1.2 core schema reader: duplicate keys refused, 64-bit integers kept apart from floats, depth and size bounded."""

from __future__ import annotations

import re

import yaml

#: Nesting depth and members of one document.
DEPTH, MEMBERS = 128, 100_000


class YamlRefused(ValueError):
    def __init__(self, code: str, message: str, line: int = 1):
        super().__init__(message)
        self.code, self.line = code, line


class _Loader(yaml.SafeLoader):
    yaml_implicit_resolvers: dict = {}

    def construct_mapping(self, node, deep=False):
        seen = set()
        for key, _ in node.value:
            name = self.construct_object(key, deep=True)
            if not isinstance(name, (str, int, float, bool, type(None))):
                raise YamlRefused("malformed-frontmatter", "a key must be a scalar", key.start_mark.line + 1)
            if name in seen:
                raise YamlRefused("duplicate-key", f"duplicate key {name}", key.start_mark.line + 1)
            if name == "__proto__":
                raise YamlRefused("malformed-frontmatter", "a reserved key", key.start_mark.line + 1)
            seen.add(name)
        return super().construct_mapping(node, deep)


def _int(loader, node):
    text = node.value
    n = int(text, 0) if text[:2] in ("0x", "0o") else int(text)
    return n if -(1 << 63) <= n < 1 << 63 else float(n)


def _float(loader, node):
    text = node.value.lower()
    return float({".nan": "nan", ".inf": "inf", "+.inf": "inf", "-.inf": "-inf"}.get(text, text))


for tag, pattern, first in (
    ("null", r"~|null|Null|NULL|", "~nN\0"),
    ("bool", r"true|True|TRUE|false|False|FALSE", "tTfF"),
    ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", "-+0123456789"),
    ("float", r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?|[-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN)", "-+0123456789."),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(rf"^(?:{pattern})$"), [c if c != "\0" else "" for c in first])
_Loader.add_constructor("tag:yaml.org,2002:int", _int)
_Loader.add_constructor("tag:yaml.org,2002:float", _float)
_Loader.add_constructor("tag:yaml.org,2002:bool", lambda loader, node: node.value.lower() == "true")


def _check(value, depth: int = 0, on: tuple = ()) -> int:
    if depth > DEPTH or id(value) in on:
        raise YamlRefused("malformed-frontmatter", "nested too deeply")
    if isinstance(value, (dict, list)):
        members = value.values() if isinstance(value, dict) else value
        n = len(members) + sum(_check(x, depth + 1, (*on, id(value))) for x in members)
        if n > MEMBERS:
            raise YamlRefused("malformed-frontmatter", "too many members")
        return n
    return 0


def read_yaml(text: str):
    """(value, {top key: line}); YamlRefused with a finding code otherwise."""
    try:
        loader = _Loader(text)
        try:
            node = loader.get_single_node()
            value = loader.construct_document(node) if node is not None else None
        finally:
            loader.dispose()
    except YamlRefused:
        raise
    except (yaml.YAMLError, ValueError, RecursionError) as e:
        mark = getattr(e, "problem_mark", None)
        raise YamlRefused("malformed-frontmatter", str(getattr(e, "problem", None) or e), mark.line + 1 if mark else 1) from None
    _check(value)
    lines = {k.value: k.start_mark.line + 1 for k, _ in node.value} if isinstance(node, yaml.MappingNode) else {}
    return value, lines

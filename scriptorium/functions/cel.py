"""Bounded rule expressions: parser, admission, and compiler to columns.

The language is the part of CEL that rules use: literals, field selection, index,
``has``, ``in``, comparisons, arithmetic, ``&& || ! ?:``, list and map literals, the
macros all, exists, exists_one, map and filter, ``size``, ``matches`` and string
functions. A rule compiles to built-in column expressions, so it runs inside the
engine's generated code. A result that isn't true or false (an absent key, a type
error) is null: rule-error, never a pass.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of admission.
LIMITS = {"bytes": 4096, "parentheses": 32, "nodes": 512, "nesting": 2, "siblings": 4, "cost": 200_000}
#: Most members of a range by the last name of its path.
RANGES = {"items": 5000, "claims": 5000, "relations": 5000, "entries": 5000, "sections": 200, "links": 10_000, "ancestry": 32}
LIST_BOUND = 1000
REFUSED = ("timestamp", "duration", "getDate", "getDayOfMonth", "getDayOfWeek", "getDayOfYear", "getFullYear", "getHours", "getMilliseconds", "getMinutes", "getMonth", "getSeconds", "format")
MACROS = ("all", "exists", "exists_one", "map", "filter")

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+u?)|(?P<str>[rR]?"(?:\\.|[^"\\])*"|[rR]?'(?:\\.|[^'\\])*')|(?P<id>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%<>!?:.,()\[\]{}]))""")
_LEVELS = [("||",), ("&&",), ("==", "!=", "<=", ">=", "<", ">", "in"), ("+", "-"), ("*", "/", "%")]


class RuleRefused(ValueError):
    """The expression is outside the admitted language."""


def _string(raw: str) -> str:
    if raw[0] in "rR":
        return raw[2:-1]
    simple = {"n": "\n", "t": "\t", "r": "\r"}
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else simple.get(m[1], m[1]), raw[1:-1])


class _Parser:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise RuleRefused(f"parse error at {at}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str:
        if self.at >= len(self.tokens) or (values and not self.peek(*values)):
            raise RuleRefused(f"parse error: expected {' or '.join(values) or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def expression(self):
        test = self.level(0)
        if self.peek("?"):
            self.take()
            a = self.level(0)
            self.take(":")
            return ("if", test, a, self.expression())
        return test

    def level(self, k: int):
        if k == len(_LEVELS):
            return self.unary()
        left = self.level(k + 1)
        while self.peek(*_LEVELS[k]):
            op = self.take()
            left = ("bin", op, left, self.level(k + 1))
        return left

    def unary(self):
        if self.peek("!", "-"):
            return ("un", self.take(), self.unary())
        return self.postfix(self.primary())

    def postfix(self, e):
        while self.peek(".", "["):
            if self.take() == "[":
                e = ("index", e, self.expression())
                self.take("]")
                continue
            name = self.take()
            if not self.peek("("):
                e = ("select", e, name)
            elif name in MACROS:
                self.take("(")
                var = self.take()
                self.take(",")
                e = ("macro", name, e, var, self.expression())
                self.take(")")
            else:
                e = ("call", name, [e, *self.arguments()])
        return e

    def arguments(self, end: str = ")", start: str = "("):
        self.take(start)
        out = []
        while not self.peek(end):
            out.append(self.expression())
            if not self.peek(end):
                self.take(",")
        self.take(end)
        return out

    def primary(self):
        if self.at >= len(self.tokens):
            raise RuleRefused("parse error: expression ends early")
        kind, text = self.tokens[self.at]
        if self.peek("("):
            self.take()
            e = self.expression()
            self.take(")")
            return e
        if self.peek("["):
            return ("list", self.arguments("]", "["))
        if self.peek("{"):
            self.take()
            pairs = []
            while not self.peek("}"):
                key = self.expression()
                self.take(":")
                pairs.append((key, self.expression()))
                if not self.peek("}"):
                    self.take(",")
            self.take("}")
            return ("map", pairs)
        self.at += 1
        if kind == "num":
            return ("lit", float(text) if "." in text else int(text.rstrip("u")))
        if kind == "str":
            return ("lit", _string(text))
        if kind == "id":
            if text in ("true", "false", "null"):
                return ("lit", {"true": True, "false": False, "null": None}[text])
            if self.peek("("):
                if text == "has":
                    (arg,) = self.arguments()
                    if arg[0] != "select":
                        raise RuleRefused("has() takes a field")
                    return ("has", arg)
                return ("call", text, self.arguments())
            if self.peek("{"):
                raise RuleRefused("message literals are refused")
            return ("id", text)
        raise RuleRefused(f"parse error at {text}")


def parse(source: str):
    p = _Parser(source)
    tree = p.expression()
    if p.at != len(p.tokens):
        raise RuleRefused("parse error: text after the expression")
    return tree


def children(node) -> list:
    kind = node[0]
    if kind in ("lit", "id"):
        return []
    if kind == "map":
        return [x for pair in node[1] for x in pair]
    if kind == "list":
        return list(node[1])
    if kind == "call":
        return list(node[2])
    if kind == "macro":
        return [node[2], node[4]]
    return [x for x in node[1:] if isinstance(x, tuple)]


def _path(node) -> list[str] | None:
    if node[0] == "id":
        return [node[1]]
    if node[0] == "select" and (up := _path(node[1])) is not None:
        return [*up, node[2]]
    if node[0] == "index" and (up := _path(node[1])) is not None:
        return [*up, str(node[2][1]) if node[2][0] == "lit" else "*"]
    return None


def _members(config, path: list[str]) -> int:
    """Most members of a configured list or mapping at a path; * stands for any key."""
    for name in path:
        if name == "*":
            return max((_members(x, path[path.index(name) + 1 :]) for x in (config.values() if isinstance(config, dict) else config)), default=0)
        config = config.get(name, ()) if isinstance(config, dict) else ()
    return len(config)


def admit(source: str, config: dict | None = None):
    """The tree of an admitted rule; RuleRefused otherwise."""
    if len(source.encode()) > LIMITS["bytes"]:
        raise RuleRefused("too many bytes")
    depth = most = 0
    for c in re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", "", source):
        depth += (c in "([{") - (c in ")]}")
        most = max(most, depth)
    if most > LIMITS["parentheses"]:
        raise RuleRefused("too many parentheses")
    tree = parse(source)
    nodes = 0

    def cost(node, bound: set, nested: int, beside: list) -> int:
        """``beside``: counts the comprehensions of one level, those in the body of another are of the next."""
        nonlocal nodes
        nodes += 1
        if node[0] == "call":
            if node[1] in REFUSED:
                raise RuleRefused(f"{node[1]} is refused")
            if node[1] == "matches" and node[2][-1][0] == "lit" and re.search(r"\(\?[=!<]|\\[1-9]", str(node[2][-1][1])):
                raise RuleRefused("lookaround and back references are refused")
        if node[0] != "macro":
            return sum(cost(x, bound, nested, beside) for x in children(node))
        beside[0] += 1
        if beside[0] > LIMITS["siblings"]:
            raise RuleRefused("too many comprehensions side by side")
        if nested + 1 > LIMITS["nesting"]:
            raise RuleRefused("comprehensions are nested too deeply")
        path = _path(node[2])
        if path is None:
            raise RuleRefused("a comprehension ranges over an interface path")
        named = [x for x in path if x != "*"]
        size = _members(config or {}, path[1:]) if path[0] == "config" else RANGES["ancestry"] if "ancestry" in path else RANGES.get(named[-1], LIST_BOUND)
        return size + size * cost(node[4], bound | {node[3]}, nested + 1, [0])

    total = cost(tree, set(), 0, [0])
    if nodes > LIMITS["nodes"]:
        raise RuleRefused("too many nodes")
    if total > LIMITS["cost"]:
        raise RuleRefused(f"static cost {total}: iterations over the largest page")
    return tree


_STRING = {
    "startsWith": lambda s, x: s.startswith(x), "endsWith": lambda s, x: s.endswith(x), "contains": lambda s, x: F.contains(s, x), "matches": lambda s, x: F.rlike(s, x),
    "trim": lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), "lowerAscii": lambda s: F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "upperAscii": lambda s: F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "replace": lambda s, a, b: F.replace(s, a, b), "split": lambda s, x: F.split(s, F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))), "string": lambda s: s.cast("string"), "int": lambda s: s.cast("long"), "double": lambda s: s.cast("double"),
}


class Const:
    """A value of the law: lists and mappings that become literals where they are used."""

    def __init__(self, value):
        self.value = value

    def column(self, _=None) -> Column:
        return _literal(self.value)


def _literal(value) -> Column:
    if isinstance(value, dict):
        return F.create_map(*(c for k, v in value.items() for c in (F.lit(str(k)), _literal(v)))) if value else F.create_map().cast("map<string,array<string>>")
    if isinstance(value, (list, tuple)):
        return F.array(*map(_literal, value)) if value else F.array().cast("array<string>")
    return F.lit(value)


class Json:
    """A value inside a VARIANT column at a path; it gets a type where it is used."""

    def __init__(self, variant: str, path: tuple, schema: dict):
        self.variant, self.path, self.schema = variant, path, schema

    def child(self, name: str) -> Json:
        return Json(self.variant, (*self.path, name), (self.schema.get("properties") or {}).get(name) or {})

    def kind(self) -> str:
        own = self.schema.get("type")
        simple = {"integer": "long", "number": "double", "boolean": "boolean", "string": "string"}
        if own == "array":
            return f"array<{simple.get((self.schema.get('items') or {}).get('type'), 'string')}>"
        return simple.get(own if isinstance(own, str) else "", "string")

    def column(self, kind: str | None = None) -> Column:
        at = "$" + "".join(f"['{k}']" for k in self.path)
        got = F.try_variant_get(F.col(self.variant), at, kind or self.kind())
        return F.coalesce(got, _literal(self.schema["default"])) if "default" in self.schema and kind != "variant" else got


class Struct:
    """A record column with the fields that it has; another field is no value, not an error of the query."""

    def __init__(self, column: Column, fields: dict):
        self._column, self.fields = column, fields

    def child(self, name: str):
        if name not in self.fields:
            return F.lit(None)
        inner = self.fields[name]
        if isinstance(inner, tuple):  # the fields of records
            return Records(self._column[name], inner[0])
        return Struct(self._column[name], inner) if isinstance(inner, dict) else self._column[name]

    def column(self, _=None) -> Column:
        return self._column


class Records(Struct):
    """An array of records."""


def as_column(value, kind: str | None = None) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    if isinstance(value, dict):
        raise RuleRefused("a mapping of the interface is no value")
    return value.column(kind) if hasattr(value, "column") else _literal(value)


class _Compiler:
    def __init__(self, env: dict):
        self.env = env

    def column(self, node, scope: dict, kind: str | None = None) -> Column:
        return as_column(self.value(node, scope), kind)

    def value(self, node, scope: dict):
        """A column, or a dict of an environment's names."""
        kind = node[0]
        if kind == "lit":
            return F.lit(node[1])
        if kind == "id":
            found = scope.get(node[1], self.env.get(node[1]))
            if found is None:
                raise RuleRefused(f"unknown name {node[1]}")
            return F.col(found) if isinstance(found, str) else found
        if kind == "select":
            return self.inside(self.value(node[1], scope), node[2])
        if kind == "has":
            try:
                found = self.value(node[1], scope)
            except RuleRefused:
                return F.lit(False)
            return F.lit(True) if isinstance(found, (dict, Const)) else as_column(found, "variant").isNotNull()
        if kind == "index":
            up, key = self.value(node[1], scope), node[2]
            if key[0] == "lit" and isinstance(key[1], str) and isinstance(up, (dict, Const, Json)):
                return self.inside(up, key[1])
            at = self.column(key, scope)
            return F.get(as_column(up), at) if key[0] == "lit" and isinstance(key[1], int) else F.try_element_at(as_column(up), at)
        if kind == "list":
            return F.array(*(self.column(x, scope) for x in node[1]))
        if kind == "map":
            return F.create_map(*(self.column(x, scope) for pair in node[1] for x in pair))
        if kind == "un":
            e = self.column(node[2], scope, "boolean" if node[1] == "!" else None)
            return ~e if node[1] == "!" else -e
        if kind == "if":
            test = self.column(node[1], scope, "boolean")
            return F.when(test, self.column(node[2], scope)).when(~test, self.column(node[3], scope))
        if kind == "macro":
            return self.macro(node, scope)
        if kind == "call":
            return self.call(node, scope)
        return self.binary(node, scope)

    @staticmethod
    def inside(up, name: str):
        if isinstance(up, dict):
            if name not in up:
                raise RuleRefused(f"unknown field {name}")
            found = up[name]
            return F.col(found) if isinstance(found, str) else Const(found) if isinstance(found, list) else found
        if isinstance(up, Const):
            if not isinstance(up.value, dict) or name not in up.value:
                raise RuleRefused(f"unknown field {name}")
            return Const(up.value[name])
        if isinstance(up, (Json, Struct)):
            return up.child(name)
        return up[name]

    def macro(self, node, scope):
        _, name, source, var, body = node
        found = self.value(source, scope)
        over = F.map_keys(as_column(found)) if isinstance(found, Const) and isinstance(found.value, dict) else as_column(found, f"array<{found.kind()[6:-1]}>" if isinstance(found, Json) and found.kind().startswith("array") else "array<string>" if isinstance(found, Json) else None)
        bind = (lambda x: Struct(x, found.fields)) if isinstance(found, Records) else (lambda x: x)
        inner = lambda x: self.column(body, scope | {var: bind(x)})
        if name == "map":
            return F.transform(over, inner)
        if name == "exists_one":
            return F.size(F.filter(over, inner)) == 1
        out = {"all": F.forall, "exists": F.exists, "filter": F.filter}[name](over, inner)
        return Records(out, found.fields) if name == "filter" and isinstance(found, Records) else out

    def call(self, node, scope):
        _, name, raw = node
        if name == "size" and len(raw) == 1:
            found = self.value(raw[0], scope)
            text = raw[0][0] == "lit" or (raw[0][0] == "call" and raw[0][1] in _STRING) or (isinstance(found, Json) and found.kind() == "string")
            return F.length(as_column(found, "string")) if text else F.size(as_column(found))
        if name in _STRING:
            return _STRING[name](*(self.column(x, scope, "string") for x in raw))
        raise RuleRefused(f"unknown function {name}")

    def binary(self, node, scope):
        _, op, left, right = node
        if op == "in":
            b = self.value(right, scope)
            if isinstance(b, dict):
                if left[0] == "lit":
                    return as_column(b[left[1]], "variant").isNotNull() if left[1] in b else F.lit(False)
                return self.column(left, scope).isin(*b)
            a = self.column(left, scope, "string")
            if isinstance(b, Const):
                return a.isin(*b.value) if b.value else F.lit(False)
            if right[0] == "map" or (right[0] == "select" and right[2] in ("links", "frontmatter", "urls")):
                return F.map_contains_key(as_column(b), a)
            return F.array_contains(as_column(b, "array<string>" if isinstance(b, Json) else None), a)
        a, b = self.value(left, scope), self.value(right, scope)
        if op in ("==", "!=") and ("lit", None) in (left, right):
            x = as_column(a if right == ("lit", None) else b, "variant")
            same = x.isNull() if not isinstance(a if right == ("lit", None) else b, Json) else x.isNull() | F.is_variant_null(x)
            return same if op == "==" else ~same
        logic = "boolean" if op in ("&&", "||") else None
        kinds = {str: "string", bool: "boolean", int: "long", float: "double"}
        of = lambda other: logic or (kinds.get(type(other[1])) if other[0] == "lit" else "string" if other[0] == "call" and other[1] in _STRING else None)
        a, b = as_column(a, of(right)), as_column(b, of(left))
        if op == "+" and any(x[0] == "lit" and isinstance(x[1], str) or x[0] == "call" and x[1] in _STRING for x in (left, right)):
            return F.concat(a, b)
        return {
            "&&": lambda: a & b, "||": lambda: a | b, "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b,
        }[op]()


def compile_rule(source: str, env: dict, config: dict | None = None) -> Column:
    """Boolean column of an admitted rule; null where it has no value. ``env``: names to columns, column names or dicts of them."""
    tree = admit(source, config)
    return _Compiler(env | ({"config": Const(config)} if config is not None else {})).column(tree, {}, "boolean")


def reads(source: str, name: str) -> bool:
    """Whether an expression uses a name of its environment."""

    def walk(node) -> bool:
        return node == ("id", name) or any(walk(x) for x in children(node)) or (node[0] == "has" and walk(node[1]))

    return walk(parse(source))


def findings(rows: DataFrame, rule: str, source: str, env: dict, message: str, severity: str = "error", config: dict | None = None) -> DataFrame:
    """Rows on which a rule is false, and those without a value as rule-error."""
    judged = rows.withColumn("_v", compile_rule(source, env, config)).filter(F.coalesce(~F.col("_v"), F.lit(True)))
    failed = F.col("_v").isNotNull()
    return judged.withColumns({"rule": F.when(failed, rule).otherwise("rule-error"), "severity": F.lit(severity), "message": F.lit(message)}).drop("_v")

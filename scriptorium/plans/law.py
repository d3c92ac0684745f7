"""The law of a bundle: engine, vocabularies, fragments and types with inheritance, read on the driver.

A snapshot holds the law's files by their path in the repository, from disk or from a
commit. Types compose root to leaf: fields are joined, section bounds tighten (the
larger minimum, the smaller maximum), rules join by id. The result is small tables
that queries join, and per-type lists of rules and field predicates.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from scriptorium.functions import text as T
from scriptorium.functions.cel import RuleRefused, admit
from scriptorium.sources.yamlcore import YamlRefused, read_yaml

RESERVED = {
    "type": {"type": "string"}, "title": {"type": "string"}, "description": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}}, "aliases": {"type": "array", "items": {"type": "string"}},
    "status": {"enum": ["active", "retired"]}, "supersedes": {"$ref": "#/$defs/page-ref-list"}, "superseded_by": {"$ref": "#/$defs/page-ref"}, "exceptions": {"type": "array"}, "meta": {},
}
#: Shapes that a field may name.
DEFS = {
    "page-ref": {"type": "string", "minLength": 1}, "page-ref-list": {"type": "array", "items": {"type": "string", "minLength": 1}},
    "pin": {"type": "object", "required": ["commit", "origin", "covers"], "properties": {"commit": {"type": "string", "pattern": "^[0-9a-f]{7,64}$"}, "origin": {"type": "string", "minLength": 1}, "covers": {"type": "array", "items": {"type": "string"}}}},
}
ENGINE = {
    "type": "object", "additionalProperties": False, "required": ["label", "content_roots"],
    "properties": {
        "schema": {"type": "string"}, "schema_version": {"type": "integer"}, "label": {"type": "string", "maxLength": 64}, "engine": {"type": "string", "minLength": 1}, "content_roots": {"type": "array", "minItems": 1, "items": {"type": "string", "minLength": 1}},
        "source_roots": {"type": "array", "items": {"type": "string", "minLength": 1}}, "local_origins": {"type": "array", "items": {"type": "object", "additionalProperties": False, "required": ["name", "path"], "properties": {"name": {"type": "string"}, "path": {"type": "string", "minLength": 1}}}},
        "libraries": {"type": "array", "items": {"type": "object", "additionalProperties": False, "required": ["path"], "properties": {"path": {"type": "string", "minLength": 1}}}}, "commit_prefixes": {"type": "array", "items": {"type": "string", "minLength": 1}},
        "field_sources": {"type": "object", "additionalProperties": False, "properties": {"title": {"const": "basename"}}}, "folder_tags": {"type": "object", "additionalProperties": False, "required": ["mode"], "properties": {"mode": {"enum": ["off", "validate", "materialize-add-only"]}}},
        "folder_tag_aliases": {"type": "object"}, "extensions": {"type": "object", "additionalProperties": False, "required": ["mode"], "properties": {"mode": {"enum": ["open", "registered"]}}},
    },
}
#: Keys of a document by kind, and where the law's files stand.
KEYS = {
    "types": "type role description use_when avoid_when extends fragments abstract instances fields sections rules configure meta examples".split(),
    "fragments": "fragment description fields sections rules configure meta".split(),
    "vocabularies": "vocabulary description mode entries retired contributes_to".split(),
}
LAW_FOLDERS = ("config/", "constitution/", "rule-tests/", "examples/")
#: Bounds of the law's own lists: facts, ancestry.
FACTS, ANCESTRY = 10_000, 32


class LawRefused(ValueError):
    """The law doesn't load; ``issues`` lists (code, where, message)."""

    def __init__(self, issues):
        self.issues = sorted(set(issues), key=lambda i: (i[1], i[0], i[2]))
        super().__init__("; ".join(f"{c} {w}: {m}" for c, w, m in self.issues))


@dataclass
class Snapshot:
    """The law's files by repository path; ``bundle`` is the bundle's own folder in the repository, "" at its top."""

    bundle: str
    files: dict[str, bytes]

    def owned(self, libraries: dict[str, str]) -> dict[tuple[str, str], bytes]:
        """(owner, path inside it) of every file: the longest root that holds it owns it; ``libraries``: id to root."""
        roots = sorted([("bundle", self.bundle), *libraries.items()], key=lambda r: -len(r[1]))
        out = {}
        for path, data in self.files.items():
            for owner, root in roots:
                if not root or path.startswith(root + "/"):
                    inside = path[len(root) + 1 :] if root else path
                    if owner != "bundle" or inside.startswith(LAW_FOLDERS):
                        out[owner, inside] = data
                    break
        return out


def resolve_in_repository(path: str) -> str | None:
    """The path with . and .. folded, NFC; None if it is absolute or leaves the repository."""
    out: list[str] = []
    if path.startswith("/") or re.match(r"^[A-Za-z]:", path) or "\\" in path:
        return None
    for part in path.split("/"):
        if part == ".." and not out:
            return None
        if part == "..":
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return unicodedata.normalize("NFC", "/".join(out))


def disk_snapshot(root: str) -> Snapshot:
    """Law files of a working tree: the bundle's law folders and the libraries that its engine document names."""
    from scriptorium.sources import git

    root = os.path.realpath(root)
    top = os.path.realpath(git.top_level(root) or root)
    bundle = "" if top == root else os.path.relpath(root, top)
    files: dict[str, bytes] = {}

    def take(folder: str) -> None:
        for at, names, found in os.walk(os.path.join(top, folder)):
            names[:] = sorted(n for n in names if n != ".git" and not os.path.islink(os.path.join(at, n)))
            for n in found:
                path = os.path.join(at, n)
                if not os.path.islink(path):
                    with open(path, "rb") as f:
                        files[os.path.relpath(path, top)] = f.read()

    for folder in LAW_FOLDERS:
        take(os.path.join(bundle, folder))
    for lib in _library_roots(files.get(os.path.join(bundle, "config/engine.json"))):
        take(lib)
    return Snapshot(bundle, files)


def git_snapshot(root: str, rev: str | None) -> Snapshot:
    """The same from a commit, or from the index if ``rev`` is None."""
    from scriptorium.sources import git

    bundle = git.prefix_of(root)
    entries = git.tree_entries(root, rev) if rev else [(m, o, f"{bundle}/{p}" if bundle else p) for m, o, p in git.index_entries(git.top_level(root) if not bundle else root)]
    at = {p: o for m, o, p in entries if m.startswith("100")}
    cut = f"{bundle}/" if bundle else ""
    engine = at.get(f"{cut}config/engine.json")
    libs = _library_roots(git.blobs(root, [engine])[engine]) if engine else []
    own = {p: o for p, o in at.items() if p[len(cut) :].startswith(LAW_FOLDERS) and p.startswith(cut) or any(p.startswith(lib + "/") for lib in libs)}
    data = git.blobs(root, list(own.values()))
    return Snapshot(bundle, {p: data[o] or b"" for p, o in own.items()})


def _library_roots(engine: bytes | None) -> list[str]:
    try:
        return [r for lib in json.loads(engine or b"{}").get("libraries", []) if (r := resolve_in_repository(lib["path"]))]
    except (ValueError, TypeError, AttributeError, KeyError):
        return []


@dataclass
class Section:
    heading: str
    pos: int
    least: int = 0
    most: int | None = None
    grammar: str = "prose"
    params: dict = field(default_factory=dict)
    path: tuple[str, ...] = ()
    scope: str = "direct"


@dataclass
class Type:
    name: str
    chain: list[str]
    abstract: bool
    role: str | None
    properties: dict
    required: list[str]
    sections: list[Section]
    ordered: bool
    additional: str
    depth: int
    rules: list[dict]
    instances: dict
    meta: list[str] = field(default_factory=list)
    fragments: list[str] = field(default_factory=list)
    extends: str | None = None
    about: dict = field(default_factory=dict)
    refs: dict[str, dict] = field(default_factory=dict)

    @property
    def ancestry(self) -> list[str]:
        return self.chain[1:]

    @property
    def transition_rows(self) -> set[str]:
        """Codes that compare this type's pages with their base."""
        codes = {"entries": "entry-edited", "claims": "claims-transition", "relations": "relation-removed"}
        return {codes[s.grammar] for s in self.sections if s.grammar in codes and (s.grammar != "entries" or s.params.get("lifecycle") == "append-only")}

    @property
    def grammar_rows(self) -> set[str]:
        """Codes that this type's sections bring; for others the code doesn't apply."""
        if not self.sections:
            return set()
        out = {"section-count", "section-depth"}
        if self.ordered:
            out.add("section-order")
        if self.additional == "refused":
            out.add("section-undeclared")
        for s in self.sections:
            if s.grammar == "prose":
                continue
            p = s.params
            out.add("item-unparsed")
            if p.get("vocabulary"):
                out |= {"vocabulary-unknown", "vocabulary-retired"}
            if s.grammar == "claims":
                out |= {c for c, on in (("category-not-allowed", p.get("categories")), ("claim-provenance", p.get("provenance", "optional") != "optional"), ("claim-closed", p.get("closed") == "refused"), ("claim-open", p.get("closed") == "required")) if on}
            if s.grammar == "relations":
                out |= {"relation-target-unresolved"} | ({"require-unmet"} if p.get("require") else set())
        return out


@dataclass
class Law:
    engine: dict
    types: dict[str, Type]
    vocabularies: dict[str, dict]
    libraries: dict[str, str] = field(default_factory=dict)
    files: dict[tuple[str, str], bytes] = field(default_factory=dict)
    fragments: dict[str, dict] = field(default_factory=dict)

    @property
    def content_roots(self) -> list[str]:
        return self.engine["content_roots"]

    @property
    def title_is_name(self) -> bool:
        return self.engine.get("field_sources", {}).get("title") == "basename"

    @property
    def folder_mode(self) -> str:
        return self.engine.get("folder_tags", {}).get("mode", "off")

    def rules(self) -> dict[str, dict]:
        """Every rule by id, with the first type that carries it."""
        return {r["id"]: r | {"type": t.name} for t in reversed(self.types.values()) for r in t.rules}

    def digest(self, version: str | None = None) -> str:
        """SHA-256 of the sorted "owner:path NUL sha256" lines of the law's files and the engine's version."""
        from scriptorium import __version__

        lines = sorted(f"{o}:{p}\0{hashlib.sha256(d).hexdigest()}\n".encode() for (o, p), d in self.files.items())
        return hashlib.sha256(b"".join(lines) + f"engine\0{version or __version__}\n".encode()).hexdigest()

    def declared_rows(self, spark: SparkSession) -> DataFrame:
        """One row per type with what the checks of its pages need; as small as the law."""
        section = "struct<path: array<string>, heading: string, scope: string, pos: int, least: int, most: int, grammar: string, provenance: string, closed: string, categories: array<string>, vocabulary: string, lifecycle: string, history: string>"
        rows = [
            (t.name, t.chain, t.abstract, t.role, t.depth, t.ordered, t.additional, t.meta, [(list(s.path), s.heading, s.scope, s.pos, s.least, s.most, s.grammar, s.params.get("provenance"), s.params.get("closed"), s.params.get("categories"), s.params.get("vocabulary"), s.params.get("lifecycle"), s.params.get("history")) for s in t.sections])
            for t in self.types.values()
        ]
        return spark.createDataFrame(rows, f"type string, chain array<string>, abstract boolean, role string, at_depth int, ordered boolean, additional string, meta array<string>, declared array<{section}>")

    def type_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t.name, t.chain, t.abstract) for t in self.types.values()], "type string, chain array<string>, abstract boolean")

    def section_rows(self, spark: SparkSession) -> DataFrame:
        rows = [
            (t.name, s.heading, s.pos, s.least, s.most, t.ordered, t.additional, t.depth, s.grammar, s.params.get("provenance"), s.params.get("closed"), s.params.get("categories"), s.params.get("vocabulary"), s.params.get("lifecycle"), json.dumps(s.params.get("require", [])))
            for t in self.types.values() for s in t.sections
        ]
        return spark.createDataFrame(rows, "type string, heading string, pos int, least int, most int, ordered boolean, additional string, depth int, grammar string, provenance string, closed string, categories array<string>, vocabulary string, lifecycle string, require string")

    def vocabulary_rows(self, spark: SparkSession) -> DataFrame:
        rows = []
        for name, v in self.vocabularies.items():
            rows += [(name, v["mode"], e, "active", None) for e in v["entries"]]
            rows += [(name, v["mode"], e, "retired", (x or {}).get("successor")) for e, x in v["retired"].items()]
        return spark.createDataFrame(rows, "vocabulary string, mode string, entry string, status string, successor string")


def _read(data: bytes, where: str, issues: list, code: str = "type-invalid") -> dict:
    try:
        text = data.decode().removeprefix("\ufeff")
        value = json.loads(text) if where.endswith(".json") else read_yaml(text)[0]
    except (YamlRefused, ValueError) as e:
        issues.append((code, where, str(e)))
        return {}
    if not isinstance(value, dict):
        issues.append((code, where, "not a mapping"))
        return {}
    return value


def _libraries(engine: dict, snapshot: Snapshot, issues: list) -> dict[str, str]:
    out: dict[str, str] = {}
    where = "bundle:config/engine.json"
    for lib in engine.get("libraries", []):
        root = resolve_in_repository(lib["path"])
        if not root:
            issues.append(("library-outside-repository", where, f"{lib['path']} is no folder inside the repository"))
            continue
        if not any(p.startswith(root + "/") for p in snapshot.files):
            issues.append(("library-missing", where, f"{lib['path']} names no folder in this tree"))
            continue
        about = next((p for p in (f"{root}/library.yaml", f"{root}/library.json") if p in snapshot.files), None)
        doc = _read(snapshot.files[about], about, issues, "library-invalid") if about else {}
        name = doc.get("id") or doc.get("library") or re.sub(r"^kit-", "", root.rpartition("/")[2])
        if not re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", str(name)):
            issues.append(("library-invalid", where, f"{lib['path']}: {name} is no library id"))
        elif name in out:
            issues.append(("constitution-collision", where, f"two libraries take the id {name}"))
        else:
            out[name] = root
    return out


def load(root: str | Snapshot) -> Law:
    """The law of a bundle (a directory or a snapshot); LawRefused lists every issue of the first stage that has any.

    Stages: the engine document, the libraries, the documents, their composition, the bounds.
    """
    snapshot = root if isinstance(root, Snapshot) else disk_snapshot(root)
    issues: list = []

    def stop() -> None:
        if issues:
            raise LawRefused(issues)

    at = f"{snapshot.bundle}/config/engine.json" if snapshot.bundle else "config/engine.json"
    where = "bundle:config/engine.json"
    if at not in snapshot.files:
        raise LawRefused([("engine-invalid", where, "there is no engine document")])
    engine = _read(snapshot.files[at], where, issues, "engine-invalid")
    issues += [("engine-invalid", where, f"{p or '/'} {m}") for p, m in _walk(engine, ENGINE)] if not issues else []
    for r in engine.get("content_roots", []) if not issues else []:
        if refusal := T.refused_path(r):
            issues.append(("engine-invalid", where, f"content root {r}: {refusal}"))
    if not issues and engine.get("engine"):
        from scriptorium import __version__

        if not T.satisfies(__version__, engine["engine"]):
            issues.append(("engine-invalid", where, f"this engine is {__version__}, the bundle wants {engine['engine']}"))
    stop()
    libraries = _libraries(engine, snapshot, issues)
    stop()
    files = snapshot.owned(libraries)
    raw: dict[str, dict] = {"types": {}, "fragments": {}, "vocabularies": {}}
    for (owner, path), data in sorted(files.items()):
        inside = path.removeprefix("constitution/") if owner == "bundle" else path
        kind, _, name = inside.partition("/")
        if kind not in raw or "/" in name or not name.endswith(".yaml") or (owner == "bundle" and inside == path):
            if owner == "bundle" and path.startswith("constitution/"):
                issues.append(("law-foreign-file", f"{owner}:{path}", "no document of the law stands here"))
            continue
        one = kind[:-1] if kind != "vocabularies" else "vocabulary"
        doc = _read(data, f"{owner}:{path}", issues, f"{one}-invalid")
        for key in doc:
            if key not in KEYS[kind]:
                issues.append((f"{one}-key-unknown", f"{owner}:{path}", str(key)))
        prefix = "" if owner == "bundle" else f"{owner}/"
        name = prefix + str(doc.get(one) or name[:-5])
        if name in raw[kind]:
            issues.append(("constitution-collision", f"{owner}:{path}", name))
        raw[kind][name] = doc | {"_prefix": prefix, "_where": f"{owner}:{path}"}
    stop()
    vocabularies = {n: {"mode": d.get("mode", "registered"), "entries": dict(d.get("entries") or {}), "retired": dict(d.get("retired") or {}), "where": d["_where"]} for n, d in raw["vocabularies"].items()}
    for n, d in raw["vocabularies"].items():
        if target := d.get("contributes_to"):
            to = _find(vocabularies, target, d["_prefix"])
            if to and not set(d.get("entries") or {}) & set(vocabularies[to]["entries"]):
                vocabularies[to]["entries"] |= d.get("entries") or {}
            else:
                issues.append(("vocabulary-collision", d["_where"], target))
    types = {n: t for n in raw["types"] if (t := _compose(n, raw, issues))}
    stop()
    for v, d in vocabularies.items():
        if len(d["entries"]) > FACTS:
            issues.append(("law-too-large", d["where"], f"{v} has {len(d['entries'])} entries"))
    stop()
    return Law(engine, types, vocabularies, libraries, files, raw["fragments"])


def _find(kind: dict, name: str, prefix: str) -> str | None:
    return next((n for n in (prefix + name, name) if n in kind), None)


def section_path(selector: str | list) -> tuple[str, ...]:
    return (selector,) if isinstance(selector, str) else tuple(selector)


def _grown(old, new) -> bool:
    """Whether a configured value only adds to the one before."""
    if isinstance(old, dict):
        return isinstance(new, dict) and all(k in new and _grown(v, new[k]) for k, v in old.items())
    if isinstance(old, list):
        return isinstance(new, list) and all(x in new for x in old)
    return old is None or old == new


def _both(old: dict | None, new: dict) -> dict:
    """A property under the declarations of two layers: both hold."""
    return new if not old else old if old == new else {"allOf": [old, new], **{k: new.get(k, old.get(k)) for k in ("$ref", "type", "default", "format") if k in new or k in old}}


#: Keywords of a field's schema by what a descendant may do with them.
MAY_RISE = "minimum exclusiveMinimum minLength minItems minProperties".split()
MAY_FALL = "maximum exclusiveMaximum maxLength maxItems maxProperties".split()
MUST_STAY = "type const".split()


def relaxed(old: dict, new: dict) -> list[tuple[str, str, str]]:
    """(code, keyword, message) where a field's new declaration admits what the old one refuses, by the keywords that both have; nothing is proven beyond them."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    out = []
    for key in sorted(old.keys() & new.keys()):
        was, now = old[key], new[key]
        told = f"{json.dumps(now)} after {json.dumps(was)}"
        if key == "enum" and isinstance(was, list) and isinstance(now, list):
            known = {json.dumps(x, sort_keys=True) for x in was}
            more = [x for x in now if json.dumps(x, sort_keys=True) not in known]
            if more:
                out.append(("shape-relaxed", key, f"{'no value is left of' if len(more) == len(now) else 'values are added to'} the list: {told}"))
        elif key in MUST_STAY and json.dumps(was, sort_keys=True) != json.dumps(now, sort_keys=True):
            out.append(("shape-relaxed", key, f"another value: {told}"))
        elif number(was) and number(now) and ((key in MAY_RISE and now < was) or (key in MAY_FALL and now > was)):
            out.append(("shape-relaxed", key, f"a wider bound: {told}"))
        elif key == "default" and json.dumps(was, sort_keys=True) != json.dumps(now, sort_keys=True):
            out.append(("default-conflict", key, f"two defaults: {told}"))
    return out


def _compose(name: str, raw: dict, issues: list) -> Type | None:
    chain, at = [], name
    while at:
        if at in chain or len(chain) > ANCESTRY:
            issues.append(("type-invalid", name, f"its ancestry returns to {at}"))
            return None
        chain.append(at)
        up = raw["types"][at].get("extends")
        at = _find(raw["types"], up, raw["types"][at]["_prefix"]) if up else None
        if up and not at:
            issues.append(("type-invalid", name, f"extends {up}, which isn't declared"))
            return None
    layers, inherited = [], 0
    for n in reversed(chain):
        own = raw["types"][n]
        inherited = len(layers)  # the layers of the ancestors, once the type itself is reached
        for f in own.get("fragments") or []:
            found = _find(raw["fragments"], f, own["_prefix"])
            if found:
                layers.append(raw["fragments"][found])
            else:
                issues.append(("type-invalid", name, f"fragment {f} isn't declared"))
        layers.append(own)
    own = raw["types"][name]
    out = Type(name, chain, bool(own.get("abstract")), None, {}, [], [], False, "allowed", 2, [], own.get("instances") or {}, extends=own.get("extends"), fragments=list(own.get("fragments") or []), about={k: own[k] for k in ("description", "use_when", "avoid_when", "examples") if k in own} | {"where": own["_where"], "prefix": own["_prefix"]})
    places: dict[tuple, Section] = {}
    for layer in layers:
        shape = layer.get("fields") or {}
        if layer.get("role") and out.role and layer["role"] != out.role:
            issues.append(("role-conflict", name, f"{out.role} and {layer['role']}"))
        out.role = layer.get("role") or out.role
        out.meta += [m for m in layer.get("meta") or [] if m not in out.meta]
        for key, declared in (shape.get("properties") or {}).items():
            out.properties[key] = _both(out.properties.get(key), declared or {})
            if str((declared or {}).get("$ref")) in ("#/$defs/page-ref", "#/$defs/page-ref-list", "#/$defs/pin"):
                ref = out.refs.setdefault(key, {"kind": declared["$ref"].rpartition("/")[2], "types": [], "roots": []})
                if t := declared.get("target_type"):
                    ref["types"].append(_find(raw["types"], t, layer["_prefix"]) or t)
                if r := declared.get("target_root"):
                    ref["roots"].append(r)
        out.required += [r for r in shape.get("required") or [] if r not in out.required]
        spec = layer.get("sections") or {}
        out.ordered, out.additional, out.depth = bool(spec.get("ordered", out.ordered)), spec.get("additional", out.additional), spec.get("depth", out.depth)
        for s in spec.get("list") or []:
            params = {k: v for k, v in s.items() if k not in ("heading", "min", "max", "grammar", "under", "scope")}
            if params.get("vocabulary"):
                params["vocabulary"] = _find(raw["vocabularies"], params["vocabulary"], layer["_prefix"]) or params["vocabulary"]
            path = (*(s.get("under") or ()), s["heading"])
            if path not in places:
                places[path] = Section(s["heading"], len(places), s.get("min", 0), s.get("max"), s.get("grammar", "prose"), params, path, s.get("scope", "direct"))
                continue
            old = places[path]
            old.least = max(old.least, s.get("min", 0))
            old.most = min((x for x in (old.most, s.get("max")) if x is not None), default=None)
            old.scope = s.get("scope", old.scope)
            if s.get("grammar", old.grammar) != old.grammar and old.grammar != "prose":
                issues.append(("sections-conflict", name, s["heading"]))
            old.grammar = s.get("grammar", old.grammar)
            for k, v in params.items():
                if k == "require":
                    old.params["require"] = old.params.get("require", []) + v
                elif old.params.get(k, v) != v:
                    issues.append(("sections-grammar-params", name, f"{s['heading']}: {k}"))
                else:
                    old.params[k] = v
        for r in layer.get("rules") or []:
            try:
                admit(r["expr"], r.get("config"))
            except RuleRefused as e:
                issues.append(("rule-invalid", f"{name}: {r.get('id')}", str(e)))
            if r["id"] in {x["id"] for x in out.rules}:
                issues.append(("rule-collision", name, r["id"]))
            out.rules.append(dict(r) | {"config": dict(r.get("config") or {}), "where": layer["_where"]})
        for rule, more in (layer.get("configure") or {}).items():
            for r in out.rules:
                if r["id"] == rule:
                    for k, v in more.items():
                        if not _grown(r["config"].get(k), v):
                            issues.append(("configure-narrows", name, f"{rule}: {k}"))
                        r["config"][k] = v
                    try:
                        admit(r["expr"], r["config"])
                    except RuleRefused as e:
                        issues.append(("rule-invalid", f"{name}: {rule}", str(e)))
    declared = lambda layer: {k: v for k, v in ((layer.get("fields") or {}).get("properties") or {}).items() if isinstance(v, dict)}
    for layer in layers[:inherited]:
        for key in declared(layer).keys() & declared(own).keys():
            issues += [(code, name, f"fields/properties/{key}/{keyword}: {message}") for code, keyword, message in relaxed(declared(layer)[key], declared(own)[key])]
    issues += [("meta-unknown", name, f"meta names {m}, which no field is") for m in out.meta if m not in out.properties and m not in RESERVED]
    out.sections = list(places.values())
    for r in out.rules:
        if r.get("section") is not None and section_path(r["section"]) not in places:
            issues.append(("rule-section-unknown", f"{name}: {r['id']}", str(r["section"])))
    for s in out.sections:
        if s.most is not None and s.least > s.most:
            issues.append(("sections-conflict", name, s.heading))
    return out


_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def _walk(value, schema: dict, at: str = "") -> list[tuple[str, str]]:
    """(pointer, message) of what breaks a schema."""
    from scriptorium.sources.markdown import _date

    out: list[tuple[str, str]] = []
    if ref := schema.get("$ref"):
        out += _walk(value, DEFS.get(ref.rpartition("/")[2], {}), at)
    for part in schema.get("allOf") or []:
        out += _walk(value, part, at)
    want = schema.get("type")
    if want:
        names = want if isinstance(want, list) else [want]
        if not any(isinstance(value, _KINDS[n]) and not (isinstance(value, bool) and n in ("integer", "number")) for n in names):
            return [*out, (at, f"must be {' or '.join(names)}")]
    if "enum" in schema and value not in schema["enum"]:
        out.append((at, "must be one of " + ", ".join(map(str, schema["enum"]))))
    if "const" in schema and value != schema["const"]:
        out.append((at, f"must be {schema['const']}"))
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append((at, "has a wrong length"))
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append((at, "must match " + schema["pattern"]))
        if schema.get("format") == "date" and (len(value) != 10 or _date(value) != "day"):
            out.append((at, "must be a date"))
        if schema.get("format") == "uri" and not re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$", value):
            out.append((at, "must be a URI"))
    if isinstance(value, (int, float)) and not isinstance(value, bool) and (value < schema.get("minimum", value) or value > schema.get("maximum", value)):
        out.append((at, "is out of bounds"))
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            out.append((at, "has a wrong number of items"))
        if schema.get("uniqueItems") and any(x in value[:k] for k, x in enumerate(value)):
            out.append((at, "has an item twice"))
        for k, x in enumerate(value):
            out += _walk(x, schema.get("items") or {}, f"{at}/{k}")
    if isinstance(value, dict):
        out += [(at, f"needs {r}") for r in schema.get("required") or [] if r not in value]
        for k, x in value.items():
            key = str(k).replace("~", "~0").replace("/", "~1")
            if k in (schema.get("properties") or {}):
                out += _walk(x, schema["properties"][k] or {}, f"{at}/{key}")
            elif schema.get("additionalProperties") is False:
                out.append((f"{at}/{key}", "isn't declared"))
            elif isinstance(schema.get("additionalProperties"), dict):
                out += _walk(x, schema["additionalProperties"], f"{at}/{key}")
    return out


def shape_errors(value: dict, t: Type, registered: bool = True) -> list[tuple[str, str]]:
    """(pointer, message) of every field that breaks the type's shape, each once: reserved fields, the type's own, nothing else under ``registered``."""
    known = RESERVED | {k: _both(RESERVED.get(k), v) for k, v in t.properties.items()}
    return list(dict.fromkeys(_walk(value, {"properties": known, "required": t.required, "additionalProperties": not registered})))


def skeleton(t: Type) -> str:
    """A page of the type to fill in: its fields, then its declared headings."""
    empty = {"string": '""', "array": "[]"}
    kind = lambda s: {"page-ref": "string", "page-ref-list": "array"}.get(str(s.get("$ref", "")).rpartition("/")[2]) or (s.get("type")[0] if isinstance(s.get("type"), list) else s.get("type"))
    fields = [k for k in RESERVED if k in ("title", "description", "tags")] + [k for k in t.properties if k not in RESERVED]
    lines = ["---", f"type: {t.name}", *(f"{k}: {empty.get(kind(t.properties.get(k) or RESERVED.get(k) or {}), 'null')}" for k in fields), "---", "", "# <title>", ""]
    written = set()
    for s in t.sections:
        for n in range(1, len(s.path) + 1):
            if s.path[:n] not in written:
                written.add(s.path[:n])
                lines += ["#" * (t.depth + n - 1) + " " + s.path[n - 1], ""]
    return "\n".join(lines) + "\n"

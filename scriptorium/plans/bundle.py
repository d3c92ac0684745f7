"""A bundle of pages under a law: check, gate, search, read, graph, rule trials.

A state is a DataFrame (path, content) and, where it has a base, base_content and
renamed_from. Pages are parsed once; each check is a query over the parsed rows,
and their union, routed, is the verdict.
"""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium import __version__
from scriptorium.functions import cel
from scriptorium.functions import text as T
from scriptorium.operators import evidence as E
from scriptorium.operators import folders, names, search, transitions, verdict
from scriptorium.plans import law as L
from scriptorium.sources import git, markdown, states, store

_PLACE = {"line": "int", "heading": "string", "occurrence": "int"}
#: Fields of the records that rules read.
_PAGE_OF = {"resolved": None, "path": None, "type": None}
_AT = {"location": {"line": None, "span": None}, "raw": None, "rationale": None, "kind": None}
RECORDS = {
    "claims": {"category": None, "core": None, "handle": None, "provenance": {"kind": None, "value": None, "page": _PAGE_OF}, "retracted": {"date": None}, "superseded": {"date": None, "by": None}, **_AT},
    "relations": {"label": None, "target": {"name": None, "heading": None, "alias": None, **_PAGE_OF}, **_AT},
    "entries": {"date": None, "precision": None, "text": None, **_AT},
}
_KIND = {"claims": "claim", "relations": "relation", "entries": "entry"}


def _finding(rows: DataFrame, rule, message, severity: str | Column = "error", details: dict | None = None, **place: Column) -> DataFrame:
    """Rows as findings (path, rule, severity, line, heading, occurrence, message, details)."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    about = F.create_map(*(c for k, v in details.items() for c in (F.lit(k), v.cast("string")))) if details else F.lit(None).cast("map<string,string>")
    return rows.select("path", as_col(rule).alias("rule"), as_col(severity).alias("severity"), *(place.get(k, F.lit(None)).cast(t).alias(k) for k, t in _PLACE.items()), F.coalesce(as_col(message).cast("string"), F.lit("")).alias("message"), about.alias("details"))


def _union(rows: list[DataFrame]) -> DataFrame:
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


class Bundle:
    """``state``: by default the files under the law's content roots. ``sources``: rows (path, kind) of the source roots, None if not measured.
    ``removed``: pages (path, content) that the base of the state had and the state has not. ``parsed``: a folder that keeps
    parsed pages from run to run; a page with the same content under the same law isn't parsed again.
    ``index``: a name index that pages are judged by instead of their own.

    Pages are parsed once into a table of the shared folder, as is what several checks read; ``close`` (or the end of a
    ``with`` block) deletes these tables.
    """

    def __init__(self, spark: SparkSession, root: str, state: DataFrame | None = None, law: L.Law | None = None, sources: DataFrame | None = None, skipped: list[tuple[str, str]] | None = None, removed: DataFrame | None = None, parsed: str | None = None, index: DataFrame | None = None):
        self.spark, self.root, self.law = spark, root, law or L.load(root)
        self.source_roots = tuple(self.law.engine.get("source_roots", ()))
        self._tables: dict[str, tuple[DataFrame, str]] = {}
        self.parsed, self.index = parsed, index
        if state is None:
            self._tables["state"] = states.settled(lambda: markdown.read_files(spark, root, self.law.content_roots), spark)
            state = self._tables["state"][0]
            skipped = markdown.walk(root, self.law.content_roots)[1] if skipped is None else skipped
            state = markdown.without(state, spark.createDataFrame(skipped, "at string, reason string")) if skipped else state
            sources = E.facts_of(spark, E.walk_sources(root, list(self.source_roots))) if sources is None else sources
        self.state, self.sources, self.skipped, self.removed = state, sources, skipped or [], removed

    def __enter__(self) -> Bundle:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        for _, path in self._tables.values():
            store.drop(self.spark, path)
        self._tables = {}

    @property
    def has_base(self) -> bool:
        return "base_content" in self.state.columns

    def pages(self, column: str = "content") -> DataFrame:
        """Parsed pages; every operator shares this one parse."""

        def rows() -> DataFrame:
            if column == "removed":
                own = self.removed if self.removed is not None else self.state.select("path", "content").limit(0)
            else:
                own = self.state if column == "content" else self.state.filter("base_content is not null").select("path", F.col("base_content").alias("content"))
            parse = lambda d: markdown.parse(d, self.source_roots, {t.name: t.depth for t in self.law.types.values() if t.depth != 2})
            return states.cached_pages(self.spark, own, parse, self.parsed, f"{__version__}-{self.law.digest()}") if self.parsed else parse(own)

        return self._kept(f"pages {column}", rows)

    def readable(self, column: str = "content") -> DataFrame:
        return self.pages(column).filter("code is null").drop("code", "message")

    @cached_property
    def _types(self) -> DataFrame:
        return F.broadcast(self.law.declared_rows(self.spark))  # bounded by the law's documents

    def typed(self, column: str = "content") -> DataFrame:
        return self.readable(column).join(self._types, "type", "left")

    def judged(self, column: str = "content") -> DataFrame:
        """Pages of a declared, concrete type."""
        return self._kept(f"judged {column}", lambda: self.typed(column).filter("chain is not null and not abstract"))

    def records(self) -> DataFrame:
        """Items of the judged pages."""
        return self._kept("records", lambda: self.items(self.judged()))

    def _kept(self, name: str, rows) -> DataFrame:
        """``rows()``, written once: what several checks read is neither planned nor made again."""
        if name not in self._tables:
            self._tables[name] = store.kept(rows(), name)
        return self._tables[name][0]

    def names(self) -> DataFrame:
        return self.index if self.index is not None else self._kept("names", lambda: names.name_index(self.readable().select("path", "type", "aliases")))

    def base_names(self) -> DataFrame:
        """The name index of the base: its pages at the paths that they had there, those among them that are gone by now."""

        def rows() -> DataFrame:
            own = lambda c: self.readable(c).select("path", "type", "aliases")
            return names.name_index(names.base_pages(own("base_content"), self.state.select("path", "renamed_from"), own("removed")))

        return self.index if self.index is not None else self._kept("names of the base", rows)

    # ---------------------------------------------------------------- sections and records

    @staticmethod
    def _policy(path: Column, declared: Column) -> Column:
        """struct<n, pos, d> of the declared section that owns a heading path: the deepest declared one that begins it, if it is the path or covers its descendants."""
        hits = F.filter(declared, lambda d: F.slice(path, F.lit(1), F.size(d["path"])) == d["path"])
        deepest = F.array_max(F.transform(hits, lambda d: F.struct(F.size(d["path"]).alias("n"), d["pos"].alias("pos"), d.alias("d"))))
        return F.when((deepest["n"] == F.size(path)) | (deepest["d"]["scope"] == "descendants"), deepest)

    def sections(self, rows: DataFrame) -> DataFrame:
        """Sections with the declared section that owns them (policy, null if none), whether it is theirs (explicit), and mode."""
        flat = rows.select("path", "type", "at_depth", "ordered", "additional", "declared", "items", F.inline("sections"))
        own = flat.withColumn("_p", self._policy(F.col("section_path"), F.col("declared")))
        mode = F.coalesce("_p.d.grammar", F.lit("unbound"))
        return own.withColumns({"policy": F.col("_p.d"), "explicit": F.coalesce(F.col("_p.n") == F.size("section_path"), F.lit(False)), "mode": mode}).drop("_p")

    def items(self, rows: DataFrame) -> DataFrame:
        """Items with the parameters of the section that owns them."""
        flat = rows.select("path", "type", "declared", "sections", F.explode("items").alias("i"))
        own = F.get(F.col("sections"), F.col("i.seq"))
        placed = flat.select("path", "type", *(own[c].alias(c) for c in ("heading", "occurrence", "address")), self._policy(own["section_path"], F.col("declared"))["d"].alias("p"), "i.*").filter("p is not null")
        params = ("grammar", "provenance", "closed", "categories", "vocabulary", "lifecycle", "history")
        return placed.select("*", F.col("p.path").alias("section"), *(F.col(f"p.{c}").alias(c) for c in params)).drop("p")

    # ---------------------------------------------------------------- checks

    def findings(self, only: DataFrame | None = None) -> DataFrame:
        """Every finding of the state, routed. ``only``: paths; of other pages, just what is found on no single page is told."""
        part = "all" if only is None else "some"
        own_part = lambda rows: rows if only is None else rows.join(only.select("path"), "path", "left_semi")
        pages, ok, typed, judged = map(own_part, (self.pages(), self.readable(), self.typed(), self.judged()))
        records, index = own_part(self.records()), self.names()
        blank = F.trim(F.coalesce("type", F.lit(""))) == ""
        first = [
            _finding(pages.filter("code is not null"), F.col("code"), F.col("message"), line=F.col("code_line")),
            _finding(ok.filter(blank), "okf-missing-type", "a page needs a type"),
            _finding(typed.filter("chain is null"), "type-unknown", F.coalesce("type", F.lit("no type"))),
            _finding(typed.filter("abstract"), "abstract-type", F.col("type")),
        ]
        own = [
            self._shapes(judged), self._references(judged, index), *self._tags(judged), self._links(judged, index), *self._sections(judged), *self._items(judged, records), self._relations(records, index), *self._rules(judged, index), self._source_paths(records), *self._unevaluated(judged),
        ]
        if self.has_base:
            own += self._renames(judged) + self._transitions(judged, index)
        on_pages = self._waived(judged, self._kept(f"on pages {part}", lambda: _union(own)))
        return self._kept(f"findings {part}", lambda: self._routed(_union([*first, on_pages, *self._wide()])))

    def _routed(self, rows: DataFrame) -> DataFrame:
        return verdict.route(rows, verdict.routes(self.spark))

    def _wide(self) -> list[DataFrame]:
        """What several pages are to each other, and what isn't read: names with two owners, numbers of pages of a type, skipped paths."""
        ok = self.readable()
        return [
            _finding(names.collisions(ok, self.law.title_is_name).filter("path <> owner"), "identity-collision", F.concat("ident", F.lit(" belongs to "), "owner")),
            self._instances(ok),
            _finding(self.spark.createDataFrame(self.skipped, "path string, reason string"), "path-skipped", F.col("reason"), "warning"),
        ]

    def wide_findings(self) -> DataFrame:
        return self._kept("wide", lambda: self._routed(_union(self._wide())))

    # ---------------------------------------------------------------- what changed names do

    def written_names(self) -> DataFrame:
        """(path, ident) of every name that the judged pages write: links, relations, cited pages, fields that name pages."""
        idents = F.concat(F.transform("links", lambda x: x["ident"]), F.transform(F.filter("items", lambda i: i["relation"].isNotNull()), lambda i: i["relation"]["ident"]), F.transform(F.filter("items", lambda i: i["claim"]["prov_kind"] == "page"), lambda i: i["claim"]["prov_key"]))
        rows, fields = self.judged().select("path", F.explode(F.array_distinct(idents)).alias("ident")), self._reference_rows(self.judged())
        return rows if fields is None else rows.union(fields.select("path", T.ident(F.trim("target_name"))))

    def renamed_users(self) -> DataFrame:
        """(path) of the pages that write a name which the base's index answers otherwise; what other pages' findings say of names is the same under both."""
        return self._kept("users of changed names", lambda: names.name_users(self.written_names(), names.name_changes(self.names(), self.base_names())))

    def name_readers(self) -> list[str]:
        return [*verdict.NAME_READERS, *self.law.rules()]

    def name_findings(self, paths: DataFrame, index: DataFrame, under: str) -> DataFrame:
        """Findings that depend on names, of the pages at ``paths`` judged under a name index."""

        def rows() -> DataFrame:
            judged = self.judged().join(paths.select("path"), "path", "left_semi")
            found = [self._references(judged, index), self._links(judged, index), self._relations(self.records().join(paths.select("path"), "path", "left_semi"), index), *self._rules(judged, index)]
            return self._routed(self._waived(judged, self._kept(f"read under {under}", lambda: _union(found)))).filter(F.col("rule").isin(*self.name_readers()))

        return self._kept(f"findings under {under}", rows)

    def _shapes(self, pages: DataFrame) -> DataFrame:
        law, registered = self.law, self.law.engine.get("extensions", {}).get("mode", "registered") == "registered"

        @F.pandas_udf("array<struct<pointer: string, message: string>>")
        def errors(kind, front):
            import pandas as pd

            return pd.Series([[{"pointer": p, "message": m} for p, m in L.shape_errors(json.loads(f), law.types[k], registered)] for k, f in zip(kind, front)])

        bad = pages.select("path", "key_lines", F.explode(errors("type", "frontmatter")).alias("e"))
        line = F.try_element_at("key_lines", T.pointer_key(F.col("e.pointer")))
        return _finding(bad, "page-shape-invalid", F.concat("e.pointer", F.lit(" "), "e.message"), details={"pointer": F.col("e.pointer"), "line": line}, line=line)

    def _references(self, pages: DataFrame, index: DataFrame) -> DataFrame:
        """Fields that name pages: the target exists, is of the type and below the root that the field asks for."""
        rows = self._reference_rows(pages)
        if rows is None:
            return _finding(pages.limit(0), "page-ref-type", "")
        found = names.resolve(rows, index).join(self._types.select(F.col("type").alias("target_type"), "chain"), "target_type", "left")
        chain = F.coalesce("chain", F.array("target_type"))
        wrong = F.filter("required", lambda r: ~F.array_contains(chain, r))
        outside = (F.size("roots") > 0) & ~F.exists("roots", lambda r: F.col("target").startswith(F.concat(r, F.lit("/"))))
        is_path = F.col("target_name").contains("/") | F.col("target_name").endswith(".md")
        kinds = F.when(F.col("target").isNull(), F.array(F.when(is_path, "path").otherwise("unresolved"))).otherwise(F.concat(F.transform(wrong, lambda _: F.lit("type")), F.when(outside, F.array(F.lit("root"))).otherwise(F.array().cast("array<string>"))))
        bad = found.withColumn("kind", F.explode(kinds))
        return _finding(bad, "page-ref-type", F.concat_ws(" ", "field", "target_name", "kind"), details={"kind": F.col("kind"), "field": F.col("field"), "target": F.coalesce("target", "target_name")})

    def _reference_rows(self, pages: DataFrame) -> DataFrame | None:
        """(path, field, target_name, required, roots) of each name in a field that names pages, None if no type has one."""
        parts = []
        fields: dict[tuple, list[str]] = {}
        for t in self.law.types.values():
            for key, ref in (self._reserved_refs() | t.refs).items():
                if ref["kind"] != "pin":
                    fields.setdefault((key, ref["kind"], tuple(ref["types"]), tuple(ref["roots"])), []).append(t.name)
        for (key, kind, types, roots), of in fields.items():
            at = f"$['{key}']"
            text = F.try_variant_get(F.try_parse_json("frontmatter"), at, "array<string>" if kind == "page-ref-list" else "string")
            value = text if kind == "page-ref-list" else F.array_compact(F.array(text))
            rows = pages.filter(F.col("type").isin(*of)).select("path", F.lit(key).alias("field"), F.explode(value).alias("target_name"), F.array(*map(F.lit, types)).cast("array<string>").alias("required"), F.array(*map(F.lit, [r for x in roots for r in (self.law.content_roots if x == "content" else [x])])).cast("array<string>").alias("roots"))
            parts.append(rows)
        return _union(parts) if parts else None

    @staticmethod
    def _reserved_refs() -> dict:
        return {k: {"kind": v["$ref"].rpartition("/")[2], "types": [], "roots": []} for k, v in L.RESERVED.items() if "$ref" in v}

    def _entries(self) -> DataFrame:
        return self.spark.createDataFrame([(e,) for e in self.law.vocabularies.get("tags", {}).get("entries", {})], "entry string")

    def _tags(self, pages: DataFrame) -> list[DataFrame]:
        law, out = self.law, []
        if "tags" in law.vocabularies:
            own = F.broadcast(law.vocabulary_rows(self.spark).filter("vocabulary = 'tags'").select("entry", "status", "successor"))
            values = pages.select("path", F.explode("tags").alias("value"), F.try_element_at("key_lines", F.lit("tags")).alias("line"))
            found = names.vocabulary_findings(values, own, law.vocabularies["tags"]["mode"])
            out.append(_finding(found, F.col("code"), F.col("value"), details={"value": F.col("value"), "line": F.col("line")}, line=F.col("line")))
        if law.folder_mode != "off":
            aliases = law.engine.get("folder_tag_aliases", {})
            inside, carried = folders.folder_rows(pages, law.content_roots, aliases), folders.tag_keys(pages)
            out.append(_finding(folders.unregistered(inside, self._entries()), "folder-segment-registered", F.col("segment"), details={"segment": F.col("segment")}))
            lack = folders.missing(inside, carried, self._entries())
            out.append(_finding(lack, "folder-tags-present", F.array_join("missing", ", "), details={"missing": F.to_json("missing"), "materialize": F.lit(law.folder_mode == "materialize-add-only")}))
            if self.has_base:
                moved = pages.join(self.state.filter("renamed_from is not null").select("path", "renamed_from"), "path")
                before = folders.folder_rows(moved, law.content_roots, {}, "renamed_from")
                left = folders.former(before, folders.folder_rows(moved, law.content_roots, {}), carried)
                out.append(_finding(left, "former-folder-tags-review", F.col("segment"), "warning", details={"segment": F.col("segment")}))
        return out or [_finding(pages.limit(0), "vocabulary-unknown", "")]

    def _links(self, pages: DataFrame, index: DataFrame) -> DataFrame:
        rows = pages.select("path", "sections", F.inline("links")).withColumnRenamed("target", "target_name").drop("heading", "alias", "ident")
        under = F.filter("sections", lambda s: s["line"] <= F.col("line"))
        place = F.get(under, F.size(under) - 1)
        found = names.resolve(rows.select("path", "target_name", "line", place["heading"].alias("heading"), place["occurrence"].alias("occurrence")), index).filter("verdict <> 'resolved'")
        rule = F.when(F.col("verdict") == "alias", "wikilink-alias-target").otherwise("wikilink-unresolved")
        message = F.when(F.col("verdict") == "alias", F.concat(F.lit("link it as "), T.basename(F.col("target")))).otherwise(F.col("target_name"))
        return _finding(found, rule, message, details={"target": F.col("target_name"), "line": F.col("line")}, line=F.col("line"), heading=F.col("heading"), occurrence=F.col("occurrence"))

    def _renames(self, pages: DataFrame) -> list[DataFrame]:
        moved = pages.select("path", "aliases").join(self.state.filter("renamed_from is not null").select("path", "renamed_from"), "path")
        moved = moved.withColumns({"_old": T.ident(T.basename(F.col("renamed_from"))), "_new": T.ident(T.basename(F.col("path")))}).filter("_old <> '' and _old <> _new")
        carried = moved.select("path", F.explode("aliases").alias("a")).select("path", T.ident("a").alias("_old"))
        return [_finding(moved.join(carried, ["path", "_old"], "left_anti"), "renamed-without-alias", F.col("renamed_from"), details={"from": F.col("renamed_from")})]

    def _source_paths(self, records: DataFrame | None = None) -> DataFrame:
        cited = (records if records is not None else self.records()).filter("claim.prov_kind = 'path'").select("path", "line", "heading", "occurrence", F.col("claim.prov_value").alias("source"))
        facts = self.sources if self.sources is not None else None
        told = E.source_status(cited, facts) if facts is not None else cited.withColumn("status", F.lit("unmeasured"))
        bad = told.filter("status <> 'present'")
        severity = F.when(F.col("status") == "unmeasured", "warning").otherwise("error")
        return _finding(bad, F.concat(F.lit("source-path-"), "status"), F.col("source"), severity, details={"source": F.col("source"), "status": F.col("status"), "line": F.col("line")}, line=F.col("line"), heading=F.col("heading"), occurrence=F.col("occurrence"))

    def _instances(self, pages: DataFrame) -> DataFrame:
        rows = [(t.name, t.instances.get("min", 0), t.instances.get("max", 1 << 60)) for t in self.law.types.values() if t.instances]
        bounds = self.spark.createDataFrame(rows, "type string, least long, most long")
        bad = names.instance_findings(pages.select("path", "type"), self.law.type_rows(self.spark).select("type", "chain"), bounds)
        return _finding(bad.withColumn("path", F.lit("")), F.col("code"), F.concat_ws(" ", "type", "pages"), details={"type": F.col("type"), "pages": F.col("pages")})

    def _sections(self, pages: DataFrame) -> list[DataFrame]:
        own = self.sections(pages)
        at = {"line": F.col("line"), "heading": F.col("heading"), "occurrence": F.col("occurrence")}
        parent = F.when(F.size("section_path") > 1, F.expr("substring(address, 1, length(address) - length(substring_index(address, '/', -1)) - 1)")).otherwise(F.lit(""))
        kept = own.filter("explicit").select("path", "line", "heading", "occurrence", "section_path", "depth", parent.alias("parent"), "address", F.col("policy.pos").alias("pos"), F.col("policy.most").alias("most"))
        findings = transitions.section_counts(kept, pages.select("path", "declared"), own.select("path", "section_path", "address", "line", "heading", "occurrence"))
        top = F.filter("declared", lambda d: F.size(d["path"]) == 1)
        named = F.exists(top, lambda d: d["heading"] == F.col("heading"))
        here = own.filter("depth = at_depth").withColumns({"named": named, "rank": F.array_position(F.transform(top, lambda d: d["heading"]), F.col("heading"))})
        late = transitions.out_of_order(here.filter("ordered and named").select("path", "line", "heading", "occurrence", "rank"))
        deep = own.withColumn("named", named).filter("depth <> at_depth and policy is null and named")
        return [
            _finding(findings, "section-count", F.col("heading"), details={"heading": F.col("heading"), "kind": F.col("kind")}, **at),
            _finding(late, "section-order", F.col("heading"), details={"heading": F.col("heading")}, **at),
            _finding(deep, "section-depth", F.col("heading"), details={"heading": F.col("heading"), "depth": F.col("depth")}, **at),
            _finding(here.filter("additional = 'refused' and not named"), "section-undeclared", F.col("heading"), details={"heading": F.col("heading")}, **at),
        ]

    @staticmethod
    def _read() -> Column:
        g = F.col("grammar")
        return F.when(g == "claims", F.col("claim").isNotNull()).when(g == "relations", F.col("relation").isNotNull()).when(g == "entries", F.col("entry").isNotNull()).otherwise(True)

    def _relations(self, records: DataFrame, index: DataFrame) -> DataFrame:
        relations = records.filter("grammar = 'relations' and relation is not null")
        unresolved = names.resolve(relations.select("path", "line", "heading", "occurrence", F.col("relation.target_name").alias("target_name")), index).filter("verdict = 'unresolved'")
        return _finding(unresolved, "relation-target-unresolved", F.col("target_name"), details={"target": F.col("target_name"), "line": F.col("line")}, line=F.col("line"), heading=F.col("heading"), occurrence=F.col("occurrence"))

    def _items(self, pages: DataFrame, rows: DataFrame) -> list[DataFrame]:
        at = {"line": F.col("line"), "heading": F.col("heading"), "occurrence": F.col("occurrence")}
        claims, relations = rows.filter("grammar = 'claims' and claim is not null"), rows.filter("grammar = 'relations' and relation is not null")
        # one row a claim, with an array of what is wrong with it
        none, provenance, closed = F.col("claim.prov_kind") == "none", F.col("provenance"), F.col("closed")
        codes = F.array_compact(F.array(
            F.when((provenance == "required") & none | (provenance == "none") & ~none, "claim-provenance"), F.when((closed == "refused") & F.col("claim.closed"), "claim-closed"), F.when((closed == "required") & ~F.col("claim.closed"), "claim-open"),
        ))
        wrong = claims.withColumn("code", F.explode(codes))
        vocabulary = F.broadcast(self.law.vocabulary_rows(self.spark).withColumnRenamed("vocabulary", "_v"))
        modes = F.broadcast(self.spark.createDataFrame([(n, v["mode"]) for n, v in self.law.vocabularies.items()], "_m string, own_mode string"))
        used = claims.select("path", "line", "heading", "occurrence", "vocabulary", "categories", F.col("claim.category").alias("value")).union(relations.select("path", "line", "heading", "occurrence", "vocabulary", F.lit(None).cast("array<string>"), F.col("relation.label")))
        used = used.join(modes, F.col("vocabulary") == F.col("_m"), "left").join(vocabulary, (F.col("vocabulary") == F.col("_v")) & (F.col("value") == F.col("entry")), "left")
        known = F.when(F.col("status") == "retired", "vocabulary-retired").when(F.col("entry").isNull() & (F.col("own_mode") == "registered"), "vocabulary-unknown")
        code = F.coalesce(known, F.when(F.col("categories").isNotNull() & ~F.array_contains("categories", F.col("value")), "category-not-allowed"))
        needs = self.spark.createDataFrame([(t.name, list(s.path), r["labels"], r["min"]) for t in self.law.types.values() for s in t.sections for r in s.params.get("require", [])], "type string, section array<string>, labels array<string>, least int")
        held = relations.groupBy("path", "address").agg(F.collect_list("relation.label").alias("own"))  # a section holds at most 5,000 items
        short = self.sections(pages).filter("policy is not null").select("path", "type", "address", "line", "heading", "occurrence", F.col("policy.path").alias("section")).join(F.broadcast(needs), ["type", "section"]).join(held, ["path", "address"], "left")
        short = short.filter(F.size(F.filter(F.coalesce("own", F.array().cast("array<string>")), lambda x: F.array_contains("labels", x))) < F.col("least"))
        return [
            _finding(rows.filter(~self._read()), "item-unparsed", F.col("raw"), details={"line": F.col("line")}, **at),
            _finding(wrong, F.col("code"), F.col("raw"), details={"line": F.col("line")}, **at),
            _finding(used.withColumn("code", code).filter("code is not null"), F.col("code"), F.col("value"), details={"value": F.col("value"), "line": F.col("line")}, **at),
            _finding(short, "require-unmet", F.array_join("labels", ","), details={"labels": F.array_join("labels", ",")}, **at),
        ]

    # ---------------------------------------------------------------- rules

    def _resolved(self, pages: DataFrame, index: DataFrame, column: str = "resolved") -> DataFrame:
        """``pages`` with a map from the identity key of every name that a page writes (links, relations, cited pages) to what it names.

        A page has at most 10,000 links, so its map is bounded; the join is by the key.
        """
        keys = F.array_distinct(F.concat(F.transform("links", lambda x: x["ident"]), F.transform(F.filter("items", lambda i: i["relation"].isNotNull()), lambda i: i["relation"]["ident"]), F.transform(F.filter("items", lambda i: i["claim"]["prov_kind"] == "page"), lambda i: i["claim"]["prov_key"])))
        rows = pages.select("path", F.explode(keys).alias("ident")).join(index, "ident", "left")
        found = F.struct(F.col("target").isNotNull().alias("resolved"), F.col("target").alias("path"), F.col("target_type").alias("type"))
        per_page = rows.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("ident", found.alias("to")))).alias(column))
        empty = F.create_map().cast("map<string,struct<resolved:boolean,path:string,type:string>>")
        return pages.join(per_page, "path", "left").withColumn(column, F.coalesce(column, empty))

    @staticmethod
    def _records(grammar: str, seq: Column, items: str = "items", resolved: str = "resolved") -> Column:
        """Records of a section in the shape that rules read."""
        kind = _KIND[grammar]
        of = lambda ident: F.coalesce(F.try_element_at(F.col(resolved), ident), F.struct(F.lit(False).alias("resolved"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("type")))

        def shape(i: Column) -> Column:
            r = i[kind]
            common = [F.struct(i["line"].alias("line"), i["span"].alias("span")).alias("location"), i["raw"].alias("raw"), i["rationale"].alias("rationale"), F.lit(kind).alias("kind")]
            if grammar == "relations":
                to = of(r["ident"])
                target = F.struct(r["target_name"].alias("name"), r["target_heading"].alias("heading"), r["target_alias"].alias("alias"), to["resolved"].alias("resolved"), to["path"].alias("path"), to["type"].alias("type"))
                return F.struct(r["label"].alias("label"), target.alias("target"), *common)
            if grammar == "entries":
                return F.struct(r["date"].alias("date"), r["precision"].alias("precision"), r["text"].alias("text"), *common)
            page = F.when(r["prov_kind"] == "page", of(r["prov_key"]))
            source = F.struct(r["prov_kind"].alias("kind"), r["prov_value"].alias("value"), page.alias("page"))
            retracted = F.when(r["retracted"].isNotNull(), F.struct(r["retracted"].alias("date")))
            superseded = F.when(r["superseded"].isNotNull(), F.struct(r["superseded"].alias("date"), r["superseded_by"].alias("by")))
            return F.struct(r["category"].alias("category"), r["core"].alias("core"), r["handle"].alias("handle"), source.alias("provenance"), retracted.alias("retracted"), superseded.alias("superseded"), *common)

        return F.transform(F.filter(items, lambda i: (i["seq"] == seq) & i[kind].isNotNull()), shape)

    def _page_env(self, t: L.Type, mark: str = "") -> dict:
        known = L.RESERVED | t.properties
        fields = {k: cel.Json(f"{mark}_front", (k,), s or {}) for k, s in known.items()}
        urls = {k: T.parse_uri(fields[k].column("string")) for k, s in t.properties.items() if (s or {}).get("format") == "uri"}
        return {
            "path": F.col(f"{mark}path"), "type": F.lit(t.name), "role": F.lit(t.role), "ancestry": cel.Const(t.ancestry), "frontmatter": fields, "fields": fields, "body": F.col(f"{mark}body"), "tags": F.col(f"{mark}tags"), "aliases": F.col(f"{mark}aliases"), "urls": urls,
            "digest": T.page_digest(F.col(f"{mark}frontmatter"), F.array(*map(F.lit, t.meta)).cast("array<string>"), F.col(f"{mark}body")),
        }

    def _rules(self, pages: DataFrame, index: DataFrame) -> list[DataFrame]:
        """All page rules in one pass over the pages, all section rules in one over the sections.

        A page's type selects its rules; each gives a struct or null, and the array of them is exploded. A rule that can't
        be compiled, or that reads what a page can't have, is a rule-error on each page that it governs.
        """
        held = [(t, r) for t in self.law.types.values() if not t.abstract for r in t.rules]
        if not held:
            return [_finding(pages.limit(0), "rule-error", "")]
        by_names = any("target" in r["expr"] or "links" in r["expr"] or "provenance" in r["expr"] for _, r in held)
        if by_names:
            pages = self._resolved(pages, index)
        else:
            pages = pages.withColumn("resolved", F.create_map().cast("map<string,struct<resolved:boolean,path:string,type:string>>"))
        governed = pages.filter(F.col("type").isin(*{t.name for t, _ in held})).withColumn("_front", F.try_parse_json("frontmatter"))
        governed = governed.drop("declared").join(self._types.select("type", "declared"), "type")
        if any(cel.reads(r["expr"], "before") for _, r in held):
            governed = self._with_before(governed, by_names)
        facts = {"vocabularies": cel.Const({n: list(v["entries"]) for n, v in self.law.vocabularies.items()}), "ancestry": cel.Const({t.name: t.ancestry for t in self.law.types.values()}), "links": F.col("resolved")}
        sections = governed.select("*", F.posexplode("sections").alias("_n", "_s")).withColumn("_policy", self._policy(F.col("_s.section_path"), F.col("declared"))["d"]["path"])
        if "_b_sections" in sections.columns:  # the base's section at the same address under the same declaration
            own = F.filter("_b_sections", lambda s: (s["address"] == F.col("_s.address")) & self._policy(s["section_path"], F.col("_b_declared"))["d"]["path"].eqNullSafe(F.col("_policy")))
            sections = sections.withColumn("_bs", F.get(own, 0))
        out = []
        for rows, wanted in ((governed, [(t, r) for t, r in held if r.get("section") is None]), (sections, [(t, r) for t, r in held if r.get("section") is not None])):
            by_section = rows is sections
            results = []
            for t, r in wanted:
                env = {"page": self._page_env(t), "facts": facts}
                on = F.col("type") == t.name
                if cel.reads(r["expr"], "before"):
                    if not self.has_base:
                        continue  # told as unevaluated
                    env["before"] = {"present": F.col("_b_path").isNotNull(), "page": self._page_env(t, "_b_") | {"type": F.coalesce("_b_type", F.lit(t.name))}}
                    on = on & F.col("_base_reads")
                if by_section:
                    path = L.section_path(r["section"])
                    grammar = next((s.grammar for s in t.sections if s.path == path), "prose")
                    env["section"] = self._section_env(grammar, "_s", F.col("_n"))
                    if "before" in env:
                        was = self._section_env(grammar, "_bs", F.col("_bs.seq"), "_b_items", "_b_resolved")
                        places = {c: F.struct(*(v.alias(n) for n, v in was[c].items())).alias(c) for c in ("location", "directLocation")}
                        whole = F.struct(cel.as_column(was["items"]).alias("items"), *places.values(), *(was[c].alias(c) for c in ("heading", "raw", "direct", "path", "mode")))
                        fields = {"items": (RECORDS[grammar],) if grammar in RECORDS else None, **{c: {"line": None, "span": None} for c in places}, "heading": None, "raw": None, "direct": None, "path": None, "mode": None}
                        env["before"]["section"] = cel.Struct(F.when(F.col("_bs").isNotNull(), whole), fields)
                    on = on & (F.col("_policy") == F.array(*map(F.lit, path)))
                told = lambda rule, severity, message, kind, r=r: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.lit(r["id"]).alias("own"), F.lit(kind).alias("kind"))
                failed = told(r["id"], r.get("severity", "error"), r["message"], None)
                try:
                    value = cel.compile_rule(r["expr"], env, r.get("config") or {})
                    rows.select(value).schema  # noqa: B018  an expression that the rows can't answer is refused here
                    results.append(F.when(on & value.isNull(), told("rule-error", "error", f"{r['id']} has no value", "non-bool")).when(on & ~value, failed))
                except (cel.RuleRefused, AnalysisException) as e:
                    results.append(F.when(on, told("rule-error", "error", f"{r['id']}: {str(e).splitlines()[0]}", "error")))
            if not results:
                continue
            place = {"line": F.col("_s.line"), "heading": F.col("_s.heading"), "occurrence": F.col("_s.occurrence")} if by_section else {}
            bad = rows.select("path", *(["_s"] if by_section else []), F.explode(F.array_compact(F.array(*results))).alias("f"))
            out.append(_finding(bad, F.col("f.rule"), F.col("f.message"), F.col("f.severity"), details={"rule": F.col("f.own"), "kind": F.col("f.kind")}, **place))
        return out or [_finding(pages.limit(0), "rule-error", "")]

    def _section_env(self, grammar: str, at: str, seq: Column, items: str = "items", resolved: str = "resolved") -> dict:
        """What rules read of a section: its column, its number, and the items and names of its page."""
        records = cel.Records(self._records(grammar, seq, items, resolved), RECORDS[grammar]) if grammar in RECORDS else F.array().cast("array<string>")
        return {"items": records, "heading": F.col(f"{at}.heading"), "raw": F.col(f"{at}.raw"), "direct": F.col(f"{at}.direct"), "path": F.col(f"{at}.heading_path"), "mode": F.lit(grammar), "location": {"line": F.col(f"{at}.line"), "span": F.col(f"{at}.span")}, "directLocation": {"line": F.col(f"{at}.line"), "span": F.col(f"{at}.direct_span")}}

    def _with_before(self, pages: DataFrame, by_names: bool = True) -> DataFrame:
        """Pages with their base page's columns under the prefix _b_, null for a new page; _base_reads is false where the base isn't a page.

        The names that a base page writes stand for what they stood for at the base.
        """
        if not self.has_base:
            return pages
        cols = ("path", "type", "frontmatter", "body", "tags", "aliases", "sections", "items", "declared", "resolved")
        base = self.pages("base_content").join(self._types.select("type", "declared"), "type", "left")
        base = self._resolved(base, self.base_names()) if by_names else base.withColumn("resolved", F.create_map().cast("map<string,struct<resolved:boolean,path:string,type:string>>"))
        base = base.select(F.col("path").alias("_p"), "code", *(F.col(c).alias(f"_b_{c}") for c in cols))
        out = pages.join(base, F.col("path") == F.col("_p"), "left").withColumn("_base_reads", F.col("code").isNull())
        return out.withColumn("_b__front", F.try_parse_json("_b_frontmatter")).drop("_p", "code")

    def _transition_rules(self, t: L.Type) -> list[str]:
        return [r["id"] for r in t.rules if cel.reads(r["expr"], "before")]

    def _unevaluated(self, pages: DataFrame) -> list[DataFrame]:
        """A row for each comparison that this state can't make: it has no base, or the base isn't a page."""
        rows = [(t.name, r) for t in self.law.types.values() for r in sorted({*t.transition_rows, *self._transition_rules(t)})]
        table = F.broadcast(self.spark.createDataFrame(rows, "type string, row string"))
        if not self.has_base:
            open_, reason = pages.select("path", "type").join(table, "type"), "no-base"
        else:
            unread = self.pages("base_content").filter("code is not null").select("path")
            open_, reason = pages.select("path", "type").join(unread, "path", "left_semi").join(table, "type"), "base-unreadable"
        return [_finding(open_, "unevaluated", F.concat("row", F.lit(f": {reason}")), "info", details={"rule": F.col("row"), "reason": F.lit(reason)})]

    def _waived(self, pages: DataFrame, found: DataFrame) -> DataFrame:
        listed = F.from_json(F.get_json_object("frontmatter", "$.exceptions"), "array<struct<rule:string,reason:string>>")
        waivers = pages.filter(F.col("frontmatter").contains('"exceptions"')).select("path", F.posexplode(listed).alias("index", "e")).filter("e.rule is not null and e.reason is not null").select("path", "e.rule", "e.reason", "index")
        known = verdict.routes(self.spark).select("rule", "severity").union(self.spark.createDataFrame([(r, "error") for r in self.law.rules()], "rule string, severity string")).dropDuplicates(["rule"])
        unjudged = found.filter("rule = 'unevaluated'").select("path", F.col("details")["rule"].alias("rule"))
        return verdict.apply_exceptions(found, waivers, known, unjudged)

    def _transitions(self, pages: DataFrame, index: DataFrame) -> list[DataFrame]:
        """Base against current of changed pages only."""
        changed = self.state.filter("base_content is not null and base_content <> content").select("path")
        now = self._kept("changed now", lambda: self.items(pages.join(changed, "path", "left_semi")))
        base = self._kept("changed base", lambda: self.items(self.judged("base_content").join(changed, "path", "left_semi")))
        entry = lambda d: d.filter("grammar = 'entries' and lifecycle = 'append-only' and entry is not null").select("path", "address", "heading", "pos", F.col("raw").alias("text"))
        dated = lambda d: d.filter("grammar = 'entries' and entry is not null").select("path", "section", "line", F.col("raw").alias("text"))
        edited = transitions.entries_edited(entry(base), entry(now), ["path", "address", "heading"])
        new = transitions.multiset_except(dated(now), dated(base), ["path", "section", "text"], ["line"])
        is_open = "grammar = 'claims' and claim is not null and not claim.closed"
        claim = lambda d: d.select("path", F.col("line").alias("pos"), F.concat_ws("\0", F.array_join("section", "\0"), "claim.category").alias("category"), F.concat_ws("\0", "claim.prov_kind", F.coalesce("claim.prov_value", F.lit(""))).alias("provenance"), F.col("claim.core").alias("core"))
        lost = transitions.claims_lost(claim(base.filter(is_open)), claim(now.filter("grammar = 'claims' and claim is not null")), new.select("path", "text"), self._kept)
        relation = lambda d: names.resolve_as(d.filter("grammar = 'relations' and relation is not null").select("path", F.array_join("section", "\0").alias("section"), F.col("line").alias("pos"), F.col("relation.label").alias("label"), F.col("relation.target_name").alias("target"), "history"), index, "target", "resolved")
        gone = transitions.relations_removed(relation(base), relation(now))
        quoted = transitions.quoted_relations(new.select(F.concat_ws("\0", "path", F.element_at("section", -1)).alias("path"), "text"))
        gone = gone.withColumn("_at", F.concat_ws("\0", "path", "history")).join(quoted.withColumnRenamed("path", "_at"), ["_at", "label", "target"], "left_anti")
        return [
            _finding(edited, "entry-edited", F.col("before"), details={"entry": F.col("pos")}, heading=F.col("heading")),
            _finding(lost, "claims-transition", F.col("core"), details={"handle": F.col("handle"), "core": F.col("core")}),
            _finding(gone, "relation-removed", F.concat_ws(" ", "label", "target"), details={"label": F.col("label"), "target": F.col("target")}),
        ]

    # ---------------------------------------------------------------- evidence

    def pins(self) -> DataFrame:
        """Measured pins of the pages whose types declare them."""
        fields = {t.name: own for t in self.law.types.values() if (own := [k for k, r in t.refs.items() if r["kind"] == "pin"])}
        origins = self.law.engine.get("local_origins", [])
        for k in range(2):  # between two looks at the heads that agree
            if "pins" in self._tables:
                break
            before = E.heads(self.root, origins)
            rows = E.measure(E.pinned(self.judged(), fields), self.root, origins, lambda name, rows, k=k: self._kept(f"{name} {k}", rows))
            made = store.kept(rows, "pins")
            if E.heads(self.root, origins) == before:
                self._tables["pins"] = made
            else:
                store.drop(self.spark, made[1])
        if "pins" not in self._tables:
            raise states.StateChanged("a repository moved on while it was read")
        return self._tables["pins"][0]

    def evidence_findings(self, pins: DataFrame) -> DataFrame:
        """Stale, unknown and unmeasured pins, citations that don't hold, and pages that name a stale page."""
        about = {"field": F.col("field"), "commit": F.col("commit"), "origin": F.col("origin")}
        unknown = pins.filter("state = 'unknown'")
        lost = pins.select("path", "field", "commit", "origin", F.explode("unresolved").alias("u"))
        via = names.stale_propagation(self.graph(), pins.filter("state = 'stale'").select("path").distinct())
        rows = _union([
            _finding(pins.filter("state = 'stale'"), "pin-stale", F.array_join("touched", ", "), "warning", details=about | {"behind": F.col("behind")}),
            _finding(unknown.filter("reason is null"), "pin-unknown", F.col("commit"), "warning", details=about),
            _finding(unknown.filter("reason = 'coverage-invalid'"), "pin-coverage-invalid", F.array_join("invalid", ", "), "warning", details=about),
            _finding(pins.filter("state = 'unmeasured'"), "pin-unmeasured", F.col("reason"), "info", details=about | {"reason": F.col("reason")}),
            _finding(lost, "citation-unresolved", F.concat_ws(" ", "u.path", F.col("u.line").cast("string"), "u.reason"), "warning", details=about | {"cited": F.col("u.path"), "reason": F.col("u.reason")}),
            _finding(via, "stale-source-cited", F.col("via"), "warning", details={"target": F.col("via")}),
        ])
        return verdict.route(rows, verdict.routes(self.spark))

    def statuses(self, pins: DataFrame | None = None) -> DataFrame:
        """(path, stale, reason) of every page, from its pins, citations and source paths and those of the pages that it names."""
        pins = pins if pins is not None else self.pins()
        source = self._source_paths().groupBy("path").agg(F.min("rule").alias("source"))
        held = pins.groupBy("path").agg(
            F.bool_or(F.col("state") == "stale").alias("stale"), F.bool_or(F.size(F.coalesce("unresolved", F.array())) > 0).alias("lost"),
            F.min(F.when(F.col("state") == "unmeasured", F.coalesce("reason", F.lit("pin-unmeasured")))).alias("unmeasured"), F.min(F.when(F.col("state") == "unknown", F.coalesce("reason", F.lit("pin-unknown")))).alias("unknown"),
        )
        rows = self.readable().select("path").join(held, "path", "left").join(source, "path", "left")
        reason = F.when(F.col("stale"), "pin-stale").when(F.col("source").isNotNull(), F.col("source")).when(F.col("lost"), "citation-unresolved").otherwise(F.coalesce("unmeasured", "unknown"))
        own = rows.select("path", F.when(F.col("stale"), F.lit(True)).when(reason.isNull(), F.lit(False)).alias("stale"), reason.alias("reason"))
        return E.page_status(self.readable().select("path"), own, self.graph())

    # ---------------------------------------------------------------- verdicts

    def governed(self) -> DataFrame:
        """(type, rule): which codes and rules apply to pages of a type."""
        always = [x.split()[0] for x in verdict.ROUTES if x.split()[0] in ("page-shape-invalid", "page-ref-type", "wikilink-unresolved", "wikilink-alias-target", "renamed-without-alias")]
        if "tags" in self.law.vocabularies:
            always += ["vocabulary-unknown", "vocabulary-retired"]
        if self.law.folder_mode != "off":
            always += ["folder-segment-registered", "folder-tags-present", "former-folder-tags-review"]
        rows = {(t.name, r) for t in self.law.types.values() if not t.abstract for r in {*always, *t.grammar_rows, *t.transition_rows, *(x["id"] for x in t.rules)}}
        return self.spark.createDataFrame(sorted(rows) or [], "type string, rule string")

    def coverage(self, found: DataFrame) -> DataFrame:
        governed = self.governed()
        unjudged = found.filter("rule = 'unevaluated'").select("path", F.col("details")["rule"].alias("rule"))
        return verdict.coverage(self.readable().select("path", "type"), governed.select("rule").distinct(), governed, unjudged)

    def scope(self) -> DataFrame:
        rows = self.sections(self.typed().filter("declared is not null"))

        def held(kind: str, read: bool) -> Column:
            return F.size(F.filter("items", lambda i: (i["seq"] == F.col("seq")) & (i[kind].isNotNull() if read else i[kind].isNull())))

        count = lambda read: sum((F.when(F.col("mode") == g, held(k, read)).otherwise(0) for g, k in _KIND.items()), F.lit(0))
        return verdict.scope_coverage(rows.select("mode", count(True).alias("records"), count(False).alias("unread")), self.readable())

    def report(self, found: DataFrame, limit: int | None = 100, rule: str | None = None, path: str | None = None) -> dict:
        """Counts, coverage and the first findings as one value; counts are over the filtered set, excepted over all."""
        chosen = verdict.filtered(found, rule, path)
        totals = verdict.totals(chosen).first().asDict()
        shown = verdict.cap(chosen, limit) if limit is not None else chosen.orderBy(*verdict.display_order())
        return {
            "summary": totals, "by_rule": {r.rule: r.findings for r in verdict.by_rule(chosen).collect()}, "excepted": {r.rule: r.excepted for r in verdict.excepted(found).collect()},
            "findings": [] if limit == 0 else [r.asDict() for r in shown.collect()], "exit": 5 if totals["errors"] else 0,
        }

    def check(self, limit: int | None = 100, rule: str | None = None, path: str | None = None, evidence: bool = True, generated: bool = False, tests: bool = False) -> dict:
        """The verdict on the state: findings of the pages, of their evidence, and, if asked, of generated files and rule tests."""
        from scriptorium.plans import artifacts, lawtests

        found = self.findings()
        has_pins = any(r["kind"] == "pin" for t in self.law.types.values() for r in t.refs.values())
        pins = self.pins() if evidence and has_pins else None
        parts = [found]
        if pins is not None:
            parts.append(self.evidence_findings(pins))
        if generated:
            parts.append(artifacts.drift_findings(self))
        if tests:
            parts.append(lawtests.findings(self.spark, self.root, self.law))
        found = self._kept("verdict", lambda: _union(parts)) if len(parts) > 1 else found
        out = self.report(found, limit, rule, path)
        out |= {"coverage": [r.asDict() for r in self.coverage(found).orderBy("rule").collect()], "scope": self.scope().first().asDict(), "unevaluated": {r.rule: r.reasons for r in verdict.unevaluated_reasons(found.filter("rule = 'unevaluated'").select(F.col("details")["rule"].alias("rule"), F.col("details")["reason"].alias("reason"))).collect()}}
        if pins is not None:
            out["pins"] = {r.state: r.pins for r in E.state_counts(pins).collect()}
            cells = E.page_cells(pins).agg(F.count_if("evaluated").alias("evaluated"), F.count_if(~F.col("evaluated")).alias("unevaluated")).first()
            rest = self.readable().count() - cells.evaluated - cells.unevaluated
            out["coverage"] += [{"rule": r, "evaluated": cells.evaluated, "not_applicable": rest, "unevaluated": cells.unevaluated} for r in ("citation-unresolved", "pin-stale", "pin-unknown")]
        return out

    def gate(self, limit: int | None = 100, message: str | None = None, rule: str | None = None, path: str | None = None) -> dict:
        """The index against HEAD: new findings of changed pages; those on inherited lines are warnings. With a commit message, its own stage."""
        from scriptorium.plans import lawdiff

        head_law = lawdiff.head_law(self.root)
        law = L.load(L.git_snapshot(self.root, None))
        if message is not None:
            return lawdiff.message_stage(self.spark, law, head_law, message)
        state = git.index_state(self.spark, self.root, law.content_roots).persist()
        prefix = git.prefix_of(self.root)
        listing = lambda rows: E.listed_sources(self.spark.createDataFrame([(m, p[len(prefix) + 1 :] if prefix else p) for m, _, p in rows if not prefix or p.startswith(prefix + "/")], "mode string, path string"), list(law.engine.get("source_roots", []))) if law.engine.get("source_roots") else None
        index_rows = [(m, o, f"{prefix}/{p}" if prefix else p) for m, o, p in git.index_entries(self.root)]
        with Bundle(self.spark, self.root, state, law, listing(index_rows), removed=git.removed_pages(self.spark, self.root, law.content_roots)) as other:
            found = other.findings()
            staged = lawdiff.law_staged(self.root, law, head_law)
            if git.head(self.root) is None or staged:
                return other.report(found, limit, rule, path) | {"scoped": False}
            scoped = other.scoped(listing(git.tree_entries(self.root, "HEAD")))
            out = other.report(scoped, limit, rule, path) | {"scoped": True, "refusals": {r.rule: r.findings for r in verdict.by_rule(scoped.filter("severity = 'error'")).collect()}}
        state.unpersist()
        return out

    def scoped(self, base_sources: DataFrame | None = None) -> DataFrame:
        """The findings that a change from the base to this state answers for: of changed pages, of what other names and source paths did, of the whole corpus; inherited errors are warnings.

        ``base_sources``: rows (path, kind) of the source roots at the base.
        """

        def rows() -> DataFrame:
            state, found = self.state, self.findings()
            lines = lambda c: state.filter(f"{c} is not null").select("path", F.posexplode(F.split(F.regexp_replace(F.regexp_replace(F.decode(c, "UTF-8"), "^﻿", ""), "\r\n", "\n"), "\n")).alias("n", "text")).withColumn("line", F.col("n") + 1)
            old = transitions.inherited(lines("base_content"), lines("content"), ["path", "text"], ["line"])
            touched = state.filter("base_content is null or base_content <> content or renamed_from is not null").select("path")
            # findings that the same pages didn't have under the base's names are the names' doing
            users = self.renamed_users()
            before = self.name_findings(users, self.base_names(), "base names")
            marked = self._source_caused(verdict.caused_by_names(found, before, users, self.name_readers()), self.sources, base_sources)
            flat = lambda c: self.readable(c).select("path", F.inline("sections")).select("path", "heading", "occurrence", "line", "raw")
            same = transitions.unchanged_sections(flat("content"), flat("base_content"))
            own = sorted({r for t in self.law.types.values() for r in self._transition_rules(t)})
            return verdict.gate_scope(marked, old, touched, verdict.VAULT_WIDE, same, own)

        return self._kept("scoped", rows)

    @staticmethod
    def _source_caused(found: DataFrame, now: DataFrame | None, before: DataFrame | None) -> DataFrame:
        """Marks source path findings whose status is another than at the base."""
        if now is None or before is None:
            return found
        cited = found.filter(F.col("rule").startswith("source-path-")).select(F.col("details")["source"].alias("source")).distinct()
        a = E.source_status(cited, now).withColumnRenamed("status", "_a")
        b = E.source_status(cited, before).withColumnRenamed("status", "_b")
        moved = a.join(b, "source").filter("_a <> _b").select(F.col("source").alias("_source"), F.lit(True).alias("_moved"))
        out = found.join(moved, F.col("details")["source"] == F.col("_source"), "left")
        return out.withColumn("caused", F.col("caused") | (F.col("_moved").isNotNull() & F.col("rule").startswith("source-path-"))).drop("_source", "_moved")

    def try_rule(self, kind: str, expr: str, section: str | list | None = None, config: dict | None = None, base: str | None = None) -> dict:
        """Paths that a candidate rule would refuse and pass on a type and its descendants, those that it can't judge, and its errors. ``base``: a revision to compare with."""
        cel.admit(expr, config)
        rule = {"id": "candidate", "expr": expr, "config": config or {}, "severity": "error", "message": "the candidate rule refuses this", "where": "candidate"} | ({"section": section} if section is not None else {})
        if kind not in self.law.types:
            raise KeyError(kind)
        import copy

        law = copy.copy(self.law)
        law.types = {n: copy.replace(t, rules=[rule]) if kind in t.chain else copy.replace(t, rules=[]) for n, t in self.law.types.items()}
        state = self.state
        if base is not None:
            old = git.revision_state(self.spark, self.root, base, law.content_roots).withColumnRenamed("content", "base_content")
            state = state.select("path", "content").join(old, "path", "left").withColumn("renamed_from", F.lit(None).cast("string"))
        with Bundle(self.spark, self.root, state, law, self.sources) as trial:
            judged = trial.judged()
            rows = _union([*trial._rules(judged, trial.names()), *trial._unevaluated(judged)]).filter(F.col("details")["rule"] == "candidate").persist()
            told = rows.select("path", "rule", "line", "message").orderBy("path", "line").collect()
            rest = judged.filter(F.exists("chain", lambda c: c == kind)).select("path").join(rows.select("path").distinct(), "path", "left_anti")
            passed = [r.path for r in rest.orderBy("path").collect()]
            rows.unpersist()
        of = lambda code: [{"path": r.path, "line": r.line, "message": r.message} for r in told if r.rule == code]
        return {"would_refuse": of("candidate"), "would_pass": passed, "unevaluated": of("unevaluated"), "errors": of("rule-error")}

    # ---------------------------------------------------------------- search, read, graph

    def searchable(self, kind: str | None = None, tag: str | None = None, title: str | None = None) -> Column:
        """Condition on pages for the search filters: a type or its descendants, a tag, a part of the title; all by identity key."""
        keep = F.lit(True)
        if kind is not None:
            keep = keep & F.col("type").isin(*[t.name for t in self.law.types.values() if any(T.fold(c) == T.fold(kind) for c in t.chain)] or [kind])
        if tag is not None:
            keep = keep & F.array_contains(F.split(T.ident(F.array_join("tags", "\x1e")), "\x1e"), T.fold(tag))
        if title is not None:
            shown = F.coalesce("title", T.basename(F.col("path"))) if self.law.title_is_name else F.col("title")
            keep = keep & F.coalesce(F.contains(T.ident(shown), F.lit(T.fold(title))), F.lit(False))
        return keep

    def search(self, query: str | None, kind: str | None = None, tag: str | None = None, title: str | None = None, **options) -> DataFrame:
        keep = self.searchable(kind, tag, title) if kind or tag or title else None
        if query is None:
            return search.only_filtered(self.readable(), keep if keep is not None else F.lit(True))
        return search.search(self.readable(), query, keep=keep, kept=lambda name, rows: self._kept(f"{name} {kind} {tag} {title}", rows), **options)

    def search_report(self, query: str | None, limit: int = 20, near: bool = False, band: str | None = None, statuses: bool = False, **filters) -> dict:
        """Results, how many were found, what was run over how many pages, and near names if asked."""
        found = self.search(query, band=band, **filters) if query is not None else self.search(None, **filters)
        found = found.persist()
        n = found.count()
        shown = found.orderBy("rank").limit(limit)
        if statuses:
            shown = shown.join(self.statuses().withColumnRenamed("reason", "stale_reason"), "path", "left").orderBy("rank")
        close = self._kept(f"near {query}", lambda: search.near(self.readable(), query, None)) if near and query is not None else None
        out = {"results": [r.asDict() for r in shown.collect()], "coverage": search.coverage_block(query, self.readable().count(), limit, n, close.count() if close is not None else None)}
        if close is not None:
            out["near"] = [r.asDict() for r in close.orderBy(F.desc("score"), T.code_units(F.col("path"))).limit(search.NEAR_LIMIT).collect()]
        found.unpersist()
        return out

    def search_items(self, query: str) -> DataFrame:
        """Ranked claims, relations and entries that hold a query's terms."""
        rows = self.items(self.judged()).filter(self._read())
        page = self.readable().select("path", F.coalesce(F.col("status") == "retired", F.lit(False)).alias("retired"))
        return search.items(rows.select("path", "line", F.col("raw").alias("core"), F.array_join("rationale", "\n").alias("rationale")).join(page, "path"), query)

    def files(self, query: str) -> DataFrame:
        return search.files(self.readable(), query)

    def near(self, query: str) -> DataFrame:
        return search.near(self.readable(), query)

    def read(self, wanted: str, section: str | None = None, budget: int | None = None) -> dict:
        from scriptorium.plans import reading

        return reading.read(self, wanted, section, budget)

    def graph(self) -> DataFrame:
        """Edges (from, to, kind, label): tagged, wikilink or cites, supersedes in its own direction, relation."""
        index, ok = self.names(), self.typed()
        none = F.lit(None).cast("string").alias("label")
        link = names.resolve(markdown.links(ok).drop("ident"), index).filter("target is not null")
        source = F.exists(F.array(*map(F.lit, self.source_roots)).cast("array<string>"), lambda r: F.col("target").startswith(F.concat(r, F.lit("/"))))
        link = link.select(F.col("path").alias("from"), F.col("target").alias("to"), F.when(source, "cites").otherwise("wikilink").alias("kind"), none)
        field = lambda k: F.coalesce(F.from_json(F.get_json_object("frontmatter", f"$.{k}"), "array<string>"), F.array(F.try_variant_get(F.try_parse_json("frontmatter"), f"$.{k}", "string")))
        named = lambda k: names.resolve(ok.filter(F.col("frontmatter").contains(f'"{k}"')).select("path", F.explode(F.array_compact(field(k))).alias("target_name")), index).filter("target is not null")
        kind = F.lit("supersedes").alias("kind")
        old = named("supersedes").select(F.col("path").alias("from"), F.col("target").alias("to"), kind, none)
        new = named("superseded_by").select(F.col("target").alias("from"), F.col("path").alias("to"), kind, none)
        rel = self.items(ok.filter("declared is not null")).filter("grammar = 'relations' and relation is not null").select("path", F.col("relation.label").alias("label"), F.col("relation.target_name").alias("target_name"))
        rel = names.resolve(rel, index).filter("target is not null").select(F.col("path").alias("from"), F.col("target").alias("to"), F.lit("relation").alias("kind"), "label")
        tag = ok.select(F.col("path").alias("from"), F.explode("tags").alias("entry"))
        if "tags" in self.law.vocabularies:
            tag = tag.join(F.broadcast(self._entries()), "entry", "left_semi")
        tag = tag.select("from", F.concat(F.lit("tag:"), "entry").alias("to"), F.lit("tagged").alias("kind"), none)
        return names.edges(link, old, new, rel, tag)

    def nodes(self) -> DataFrame:
        """(id, kind, type, title): every page and every registered tag."""
        shown = F.coalesce("title", T.basename(F.col("path"))) if self.law.title_is_name else F.col("title")
        pages = self.pages().select(F.col("path").alias("id"), F.lit("page").alias("kind"), F.nullif(F.col("type"), F.lit("")).alias("type"), shown.alias("title"))
        none = F.lit(None).cast("string")
        return pages.union(self._entries().select(F.concat(F.lit("tag:"), "entry"), F.lit("tag"), none, none))

    def digest(self) -> str:
        return verdict.content_digest(self.state).first().digest

    def census(self) -> DataFrame:
        """(vocabulary, value, uses) of tags, categories and labels."""
        rows = self.items(self.judged())
        used = rows.filter("grammar = 'claims' and claim is not null and vocabulary is not null").select("vocabulary", F.col("claim.category").alias("value"))
        used = used.union(rows.filter("grammar = 'relations' and relation is not null and vocabulary is not null").select("vocabulary", F.col("relation.label")))
        used = used.union(self.judged().select(F.lit("tags"), F.explode("tags")))
        return used.groupBy("vocabulary", "value").agg(F.count("*").alias("uses")).orderBy("vocabulary", F.desc("uses"), "value")

    def types(self, name: str | None = None, concrete: bool = False, brief: bool = False) -> list[dict]:
        """Declared types; one by name with its skeleton."""
        own = [t for t in self.law.types.values() if (name is None or t.name == name) and not (concrete and t.abstract)]
        if brief:
            return [{"type": t.name, "role": t.role, "description": t.about.get("description")} for t in own]
        rows = [{"type": t.name, "role": t.role, "abstract": t.abstract, "chain": t.chain, "required": t.required, "fields": sorted(t.properties), "sections": [list(s.path) for s in t.sections], "rules": [r["id"] for r in t.rules], **t.about} for t in own]
        return [r | {"skeleton": L.skeleton(self.law.types[r["type"]])} for r in rows] if name is not None else rows


"""Evidence: source paths, citations of repository files, pins and the freshness of pages."""

from __future__ import annotations

import os
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.sources import store

# ------------------------------------------------------------------ source facts


def walk_sources(root: str, roots: list[str]) -> list[tuple[str, str]]:
    """(path, kind) below the source roots: file, directory, or skipped (a link, or a folder that is a repository). Names only, no contents."""
    out: set[tuple[str, str]] = set()
    nfc = lambda p: unicodedata.normalize("NFC", p)
    for top in roots:
        full = os.path.join(root, top)
        if os.path.islink(full):
            out.add((nfc(top), "skipped"))
        elif os.path.isfile(full):
            out.add((nfc(top), "file"))
        for at, folders, names in os.walk(full) if not os.path.islink(full) else ():
            inside = os.path.relpath(at, root)
            out.add((nfc(inside), "directory"))
            for n in list(folders):
                if os.path.islink(os.path.join(at, n)) or os.path.exists(os.path.join(at, n, ".git")):
                    folders.remove(n)
                    out.add((nfc(f"{inside}/{n}"), "skipped"))
            out |= {(nfc(f"{inside}/{n}"), "skipped" if os.path.islink(os.path.join(at, n)) else "file") for n in names}
    return sorted(out)


def listed_sources(entries: DataFrame, roots: list[str]) -> DataFrame:
    """The same (path, kind) from a tree listing (mode, path): each leading part of a path is a directory."""
    under = F.exists(F.array(*map(F.lit, roots)), lambda r: (F.col("path") == r) | F.col("path").startswith(F.concat(r, F.lit("/"))))
    own = entries.filter(under)
    files = own.select("path", F.when(F.col("mode").isin("120000", "160000"), "skipped").otherwise("file").alias("kind"))
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = own.filter(F.size(parts) > 1).select(F.explode(prefixes).alias("path")).filter(under).select("path", F.lit("directory").alias("kind"))
    return files.union(folders).distinct()


#: Rows by which a name or a leading part is frequent: what is known of it goes to its rows, which aren't shuffled by it.
FREQUENT = 100_000


def source_status(cited: DataFrame, facts: DataFrame) -> DataFrame:
    """``cited`` (…, source) with status: unmeasured behind something skipped, else present, missing, or kind (a file cited as a folder).

    All joins are by equal paths; what may be skipped is looked up by each leading part of the cited path. Of names and
    leading parts that FREQUENT rows share there are few, so they are broadcast; other rows meet theirs in a hash table and aren't sorted.
    """
    folder = F.col("source").endswith("/")
    name = F.coalesce(F.regexp_replace("source", "/$", ""), F.lit("\0"))  # which no path holds
    rows = cited.withColumns({"_folder": folder, "_name": name})
    names = rows.groupBy("_name").agg(F.count("*").alias("_n"))
    parts = F.split("_name", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    leading = names.select("_name", F.explode(prefixes).alias("path"))
    often = leading.groupBy("path").agg(F.count("*").alias("_n")).filter(F.col("_n") >= FREQUENT).select("path")
    skipped = facts.filter("kind = 'skipped'").select("path").distinct()
    near = leading.join(F.broadcast(often.join(skipped, "path", "left_semi")), "path", "left_semi")
    far = leading.join(F.broadcast(often), "path", "left_anti").join(skipped.hint("shuffle_hash"), "path", "left_semi")
    hidden = near.union(far).select("_name").distinct().withColumn("_hidden", F.lit(True))
    held = facts.filter("kind <> 'skipped'").groupBy(F.col("path").alias("_name")).agg(F.min("kind").alias("_kind"))  # a directory wins
    told = names.join(hidden.hint("shuffle_hash"), "_name", "left").join(held.hint("shuffle_hash"), "_name", "left")
    common, rare = F.broadcast(told.filter(F.col("_n") >= FREQUENT)), told.filter(F.col("_n") < FREQUENT).hint("shuffle_hash")
    known = rows.join(common, "_name").unionByName(rows.join(common, "_name", "left_anti").join(rare, "_name"))
    status = (
        F.when(F.col("_hidden").isNotNull(), "unmeasured").when(F.col("_kind") == "directory", "present")
        .when(F.col("_kind") == "file", F.when(F.col("_folder"), "kind").otherwise("present")).otherwise("missing")
    )
    return known.withColumn("status", status).drop("_name", "_folder", "_n", "_hidden", "_kind")


# ------------------------------------------------------------------ citations

#: A code span (a run of backticks up to the next run of its length), what can't be a path, and a path with lines.
_SPAN, _NO_PATH, _CITED = r"(?s)(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", r"[*{<$\s]|://", r"^([^\s:]*)(?::([0-9]+)(?:-([0-9]+))?)?$"


def owns(covers: Column, path: Column) -> Column:
    """Whether one of the covers (array of path, kind) holds the path: all of them below ".", else by its own path, a tree by the start too."""
    return F.exists(covers, lambda c: (c["path"] == ".") | (c["path"] == path) | ((c["kind"] == "tree") & path.startswith(F.concat(c["path"], F.lit("/")))))


def spans(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, token, raw, first, last) of the code spans of bodies (keys, body) that can be read as a path, as lines or as both."""
    token = bodies.select(*keys, F.posexplode(F.regexp_extract_all("body", F.lit(_SPAN), F.lit(2))).alias("pos", "token"))
    part = lambda k: F.regexp_extract("token", _CITED, k)
    number = lambda k: F.when(part(k) != "", F.coalesce(part(k).try_cast("long"), F.lit(1 << 62)))  # noqa: E731  more digits than a line number has
    read = token.filter(~F.col("token").rlike(_NO_PATH) & F.col("token").rlike(_CITED)).select("*", part(1).alias("raw"), number(2).alias("first"), number(3).alias("last"))
    return read.filter("raw <> '' or first is not null")


def placed(read: DataFrame) -> DataFrame:
    """Spans (raw, first, top, covers) with ``kind`` and ``file``: a citation's own path, what the lines after it belong to ("" for a file outside).

    kind: lines (no path), owned, outside, ambiguous (several covered files have the name); spans of prose are left out.
    """
    name = F.regexp_replace("raw", "/+$", "")
    leaf = F.substring_index(name, "/", -1)
    by_place = F.array_contains("top", F.substring_index(name, "/", 1)) | F.col("raw").endswith("/") | (name.contains("/") & leaf.contains("."))
    same = F.transform(F.filter("covers", lambda c: (c["kind"] == "blob") & (F.substring_index(c["path"], "/", -1) == name)), lambda c: c["path"])
    by_name = ~by_place & ~name.contains("/") & name.contains(".")
    at = F.when(by_place, name).when(by_name & (F.size(same) == 1), F.get(same, 0))
    kind = (
        F.when(name == "", "lines").when(by_place & T.path_refusal(name).isNotNull(), "outside").when(by_name & (F.size(same) > 1), "ambiguous")
        .when(at.isNotNull(), F.when(owns(F.col("covers"), at), "owned").otherwise("outside"))
    )
    tree = F.col("raw").endswith("/") | F.exists("covers", lambda c: (c["kind"] == "tree") & (c["path"] == F.col("at")))
    rows = read.withColumns({"at": at, "kind": kind}).filter("kind is not null")
    return rows.withColumn("file", F.when(F.col("kind").isin("outside", "ambiguous"), F.lit("")).when((F.col("kind") == "owned") & ~tree, F.col("at")))


def carried(rows: DataFrame, keys: list[str], column: str = "file") -> DataFrame:
    """Rows with the last known value of the column at or before them, in the order of pos; null before the first."""
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))


def citations(read: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token, cited, line, problem, outside): what each placed span cites, or why it can't be told, or that it is outside the covers.

    Lines alone belong to the file before them; before any file they are unattached. Lines count up from 1.
    """
    rows = carried(placed(read), keys)
    alone = F.col("kind") == "lines"
    outside = (F.col("kind") == "outside") | (alone & (F.col("file") == ""))
    malformed = (F.col("first") < 1) | (F.col("last") < F.col("first"))
    problem = F.when(F.col("kind") == "ambiguous", "ambiguous").when(alone & F.col("file").isNull(), "unattached").when(~outside & F.coalesce(malformed, F.lit(False)), "malformed")
    told = rows.withColumns({"problem": problem, "outside": F.coalesce(outside, F.lit(False))})
    cites = F.col("problem").isNull() & ~F.col("outside")
    return told.select(*keys, "token", F.when(cites, F.when(alone, F.col("file")).otherwise(F.col("at"))).alias("cited"), F.when(cites, F.coalesce("last", "first")).alias("line"), "problem", "outside")


# ------------------------------------------------------------------ pins

STATES = ("current", "unchanged", "stale", "unknown", "unmeasured")
PIN = "struct<commit:string,origin:string,covers:array<string>>"


def pinned(pages: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """(path, field, commit, origin, covers, body) of well-formed pins. ``fields``: type to the fields that hold its pins."""
    out = None
    for name in sorted({f for own in fields.values() for f in own}):
        types = [t for t, own in fields.items() if name in own]
        pin = F.from_json(F.get_json_object("frontmatter", f"$['{name}']"), PIN)
        rows = pages.filter(F.col("type").isin(*types)).select("path", F.lit(name).alias("field"), pin.alias("p"), "body")
        out = rows if out is None else out.union(rows)
    if out is None:
        return pages.select("path", F.lit("").alias("field"), F.lit("").alias("commit"), F.lit("").alias("origin"), F.array().cast("array<string>").alias("covers"), "body").limit(0)
    good = F.col("p.commit").rlike("^[0-9a-f]{7,64}$") & (F.trim("p.origin") != "") & F.col("p.covers").isNotNull()
    return out.filter(good).select("path", "field", "p.commit", F.trim("p.origin").alias("origin"), "p.covers", "body")


def repositories(root: str, origins: list[dict]) -> dict[str, dict]:
    """Origin name to its repository: dir, head, shallow, and the reason for which it can't be measured."""
    from scriptorium.sources import git

    real = os.path.realpath(root)
    paths = {".": real} | {o["name"]: os.path.realpath(os.path.join(real, o["path"])) for o in origins}
    out: dict[str, dict] = {}
    for name, path in paths.items():
        top = git.top_level(path) if os.path.isdir(path) else None
        top = os.path.realpath(top) if top else None
        reason = "no-repository" if top is None else "not-root" if name != "." and top != path else "no-head" if git.head(top) is None else None
        out[name] = {"dir": top, "head": git.head(top) if top and not reason else None, "shallow": bool(top) and git.is_shallow(top), "reason": reason}
    shared = [r["dir"] for r in out.values() if r["dir"]]
    for r in out.values():
        if r["dir"] and shared.count(r["dir"]) > 1:
            r["reason"] = "duplicate-root"
    return out


_FACTS = "origin string, commit string, resolved string, reached boolean, behind long, changed array<string>, top array<string>"
_OBJECTS = "origin string, resolved string, path string, kind string, lines long"


def _by_origin(frames, of: dict, ask, columns: list[str]):
    """Rows of ``ask(repository, rows of its origin)`` for the rows of a task: a question to git holds all of an origin's rows."""
    import pandas as pd

    held = pd.concat([f for f in frames] or [pd.DataFrame({"origin": []})])
    for origin, rows in held.groupby("origin"):
        yield pd.DataFrame(ask(of[origin], rows), columns=columns)


def heads(root: str, origins: list[dict]) -> dict[str, str | None]:
    """The head of each repository at this moment."""
    return {name: r["head"] for name, r in repositories(root, origins).items()}


def commit_facts(named: DataFrame, bound: dict) -> DataFrame:
    """What the repositories know of the commits (origin, commit): five processes an origin and task, however many there are."""
    from scriptorium.sources import git

    def ask(at, rows):
        told = git.commits(at["dir"], sorted(set(rows["commit"])), at["head"])
        return [(rows["origin"].iloc[0], c, *told[c]) for c in sorted(told)]

    return named.select("origin", "commit").distinct().mapInPandas(lambda frames: _by_origin(frames, bound, ask, ["origin", "commit", "resolved", "reached", "behind", "changed", "top"]), _FACTS)


def objects(wanted: DataFrame, bound: dict) -> DataFrame:
    """Kind (null if missing) and number of lines of the paths (origin, resolved, path) at their commits: two kinds of processes an origin and task."""
    from scriptorium.sources import git

    def ask(at, rows):
        pairs = sorted(set(zip(rows["resolved"], rows["path"], strict=True)))
        told = git.kinds(at["dir"], [f"{c}:{'' if p == '.' else p}" for c, p in pairs])
        return [(rows["origin"].iloc[0], c, p, kind, lines) for (c, p), (kind, lines) in zip(pairs, told, strict=True)]

    return wanted.select("origin", "resolved", "path").distinct().mapInPandas(lambda frames: _by_origin(frames, bound, ask, ["origin", "resolved", "path", "kind", "lines"]), _OBJECTS)


def measure(rows: DataFrame, root: str, origins: list[dict], kept=None) -> DataFrame:
    """Pins (pinned rows) measured against their repositories, MEASURED; workers ask git, so they must reach the repositories.

    Commits, covers and cited paths are tables: each is asked for once, in batches, and joined with the pins. ``kept``:
    name and rows to the table read back, as what git says is read several times.
    """
    kept = kept or (lambda name, rows: store.kept(rows(), name)[0])
    bound, spark = repositories(root, origins), rows.sparkSession
    pin = ["path", "field"]
    table = spark.createDataFrame([(n, r["head"], r["reason"], r["shallow"]) for n, r in bound.items()], "origin string, head string, why string, shallow boolean")
    pins = rows.join(F.broadcast(table), "origin", "left").withColumn("why", F.when(F.col("shallow").isNull(), "remote-origin").otherwise(F.col("why")))  # origins: bounded by the law
    facts = kept("pinned commits", lambda: commit_facts(pins.filter("why is null"), bound))
    pins = pins.join(facts, ["origin", "commit"], "left")
    open_ = pins.filter("why is null and reached")

    listed = open_.select(*pin, "origin", "resolved", F.posexplode("covers").alias("k", "cover")).withColumn("at", F.regexp_replace("cover", "/$", ""))
    sane = (F.col("cover") == ".") | (T.path_refusal(F.col("at")).isNull() & ~F.col("at").startswith(":"))
    found = kept("covers", lambda: objects(listed.filter(sane).select("origin", "resolved", F.col("at").alias("path")), bound))
    held = listed.join(found.select("origin", "resolved", F.col("path").alias("at"), "kind"), ["origin", "resolved", "at"], "left")
    fits = sane & F.coalesce(F.col("kind").isin("blob", "tree") & ((F.col("kind") == "tree") | ~F.col("cover").endswith("/")), F.lit(False))
    listed_as = lambda c, keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("k", c.alias("c"))))), lambda x: x["c"])  # noqa: E731  as many as the pin has
    covered = held.groupBy(*pin).agg(listed_as(F.struct(F.col("at").alias("path"), "kind"), fits).alias("owned"), listed_as(F.col("cover"), ~fits).alias("bad"))
    pins = pins.join(covered, pin, "left").withColumn("invalid", F.when(F.size("covers") == 0, F.array(F.lit("<empty>"))).otherwise(F.coalesce("bad", F.array().cast("array<string>"))))
    good = pins.filter("why is null and reached and size(invalid) = 0").select(*pin, "origin", "resolved", "top", F.array_distinct("owned").alias("covers"), "body")

    read = spans(good, [*pin, "origin", "resolved", "top", "covers"])
    cited = kept("citations", lambda: citations(read, [*pin, "origin", "resolved"]))
    places = cited.filter("cited is not null").select(*pin, "origin", "resolved", F.col("cited").alias("at"), "line").distinct()
    there = kept("cited objects", lambda: objects(places.select("origin", "resolved", F.col("at").alias("path")), bound))
    judged = places.join(there.withColumnRenamed("path", "at"), ["origin", "resolved", "at"], "left")
    why = F.when(F.col("kind").isNull(), "missing").when(F.col("line") > F.coalesce("lines", F.lit(0)), "past-end")
    lost = F.struct(F.col("at").alias("path"), F.when(why == "past-end", F.col("line")).cast("int").alias("line"), why.alias("reason"))
    by_path = judged.groupBy(*pin).agg(F.count("*").alias("checked"), F.collect_set(F.when(why.isNotNull(), lost)).alias("lost"))
    odd = F.struct(F.col("token").alias("path"), F.lit(None).cast("int").alias("line"), F.col("problem").alias("reason"))
    by_span = cited.groupBy(*pin).agg(F.count_if("outside").alias("outside"), F.collect_set(F.when(F.col("problem").isNotNull(), odd)).alias("odd"))

    out = pins.join(by_path, pin, "left").join(by_span, pin, "left")
    measured = F.col("why").isNull() & F.coalesce(F.col("reached"), F.lit(False))
    ok = measured & (F.size("invalid") == 0)
    touched = F.filter("changed", lambda p: owns(F.transform("owned", lambda c: F.struct(c["path"].alias("path"), F.lit("tree").alias("kind"))), p))
    state = (
        F.when(F.col("why").isNotNull() | (~measured & F.col("shallow")), "unmeasured").when(~measured | ~ok, "unknown").when(F.size(touched) > 0, "stale")
        .when(F.col("head") == F.col("resolved"), "current").otherwise("unchanged")
    )
    reason = F.coalesce("why", F.when(~measured & F.col("shallow"), "shallow").when(measured & ~ok, "coverage-invalid"))
    none = F.array().cast("array<struct<path:string,line:int,reason:string>>")
    only = lambda c, when: F.when(when, c)
    return out.select(
        *pin, "commit", "origin", "head", state.alias("state"), reason.alias("reason"), only(F.col("resolved"), measured).alias("resolved"), only(F.col("behind"), ok).alias("behind"), only(touched, ok).alias("touched"), only(F.col("invalid"), measured & ~ok).alias("invalid"),
        only(F.coalesce("checked", F.lit(0)), ok).cast("long").alias("checked"), only(F.coalesce("outside", F.lit(0)), ok).cast("long").alias("outside"), only(F.array_sort(F.concat(F.coalesce("lost", none), F.coalesce("odd", none))), ok).alias("unresolved"),
    )


def state_counts(pins: DataFrame) -> DataFrame:
    """(state, pins): every state has a row."""
    domain = pins.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return F.broadcast(domain).join(pins.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).cast("long").alias("pins"))


def page_cells(pins: DataFrame) -> DataFrame:
    """(path, evaluated): a page counts as evaluated only if each of its pins was measured."""
    return pins.groupBy("path").agg(F.bool_and(F.col("state") != "unmeasured").alias("evaluated"))


def page_status(pages: DataFrame, own: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, stale, reason) of pages (path): their own status (path, stale, reason) and that of the pages that they name.

    stale is true, null (not known) or false, in this precedence; an own reason comes before one of a named page. Tag edges don't count.
    """
    to = own.select(F.col("path").alias("to"), "stale", F.lit(True).alias("_has"))
    linked = edges.filter("kind <> 'tagged' and `from` <> `to`").select(F.col("from").alias("path"), "to").distinct()
    named = linked.join(to, "to").groupBy("path").agg(F.max(F.coalesce("stale", F.lit(False))).alias("_stale"), F.max(F.col("stale").isNull()).alias("_open"))
    rows = pages.select("path").join(own.select("path", "stale", "reason", F.lit(True).alias("_own")), "path", "left").join(named, "path", "left")
    mine = F.when(F.col("_own").isNull(), F.lit(False)).otherwise(F.col("stale"))
    there, unsure = F.coalesce("_stale", F.lit(False)), F.coalesce("_open", F.lit(False))
    stale = F.when(mine | there, F.lit(True)).when(mine.isNull() | unsure, F.lit(None).cast("boolean")).otherwise(F.lit(False))
    reason = F.when(mine, F.col("reason")).when(there, F.lit("stale-source-cited")).when(mine.isNull(), F.col("reason")).when(unsure, F.lit("source-unverified-cited"))
    return rows.select("path", stale.alias("stale"), reason.alias("reason"))


def facts_of(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "path string, kind string")

"""Git connector: snapshots of an index or a revision as (path, content) rows; driver-side subprocesses."""

from __future__ import annotations

import subprocess
import tempfile
import threading
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIMEOUT = 60


class GitAnswerRefused(RuntimeError):
    """An answer without its terminator, or cut short."""


#: At most so many git processes at a time.
_SLOTS = threading.BoundedSemaphore(4)


def git(root: str, *args: str, data: bytes | None = None) -> bytes:
    """Output of a git command, by way of a file, so a long answer takes no memory twice."""
    with _SLOTS, tempfile.TemporaryFile() as out:
        done = subprocess.run(["git", "-C", root, *args], input=data, stdout=out, stderr=subprocess.PIPE, timeout=TIMEOUT)
        if done.returncode:
            raise RuntimeError(done.stderr.decode(errors="replace").strip() or f"git {args[0]} failed")
        out.seek(0)
        return out.read()


def ask(root: str, *args: str) -> str | None:
    """One line of a git command's answer, None where git refuses."""
    try:
        return git(root, *args).decode().rstrip("\n")
    except RuntimeError:
        return None


def _fields(raw: bytes) -> list[str]:
    if raw and not raw.endswith(b"\0"):
        raise GitAnswerRefused("the answer isn't terminated")
    return [x.decode() for x in raw.split(b"\0")[:-1]]


def parse_name_status(raw: bytes) -> list[tuple[str, str, str | None]]:
    """(status letter, path, renamed from) of ``diff --name-status -z``."""
    f, out, k = _fields(raw), [], 0
    while k < len(f):
        letter = f[k][:1]
        if letter in "RC":
            out.append((letter, f[k + 2], f[k + 1]))
            k += 3
        else:
            out.append((letter, f[k + 1], None))
            k += 2
    return out


def parse_batch(raw: bytes, count: int) -> list[bytes | None]:
    """Objects of ``cat-file --batch``, None where missing; byte-exact, a short answer is an error."""
    out, at = [], 0
    for _ in range(count):
        end = raw.find(b"\n", at)
        if end < 0:
            raise GitAnswerRefused("the batch ends early")
        head = raw[at:end].decode("ascii").split(" ")
        at = end + 1
        if head[-1] == "missing":
            out.append(None)
            continue
        size = int(head[2])
        if len(raw) < at + size + 1 or raw[at + size : at + size + 1] != b"\n":
            raise GitAnswerRefused("an object is cut short")
        out.append(raw[at : at + size])
        at += size + 1
    return out


def staged(root: str) -> list[tuple[str, str, str | None]]:
    return parse_name_status(git(root, "diff", "--cached", "--name-status", "-z", "-M", "--relative"))


def index_entries(root: str) -> list[tuple[str, str, str]]:
    """(mode, object, path) of stage 0."""
    out = []
    for line in _fields(git(root, "ls-files", "-s", "-z")):
        head, path = line.split("\t", 1)
        mode, oid, stage = head.split(" ")
        if stage == "0":
            out.append((mode, oid, path))
    return out


def tree_entries(root: str, rev: str) -> list[tuple[str, str, str]]:
    out = []
    for line in _fields(git(root, "ls-tree", "-r", "-z", "--full-tree", rev)):
        head, path = line.split("\t", 1)
        mode, kind, oid = head.split(" ")
        if kind == "blob":
            out.append((mode, oid, path))
    return out


def parse_batch_check(raw: bytes) -> list[tuple[str, str | None, int | None]]:
    """(name, type, size) of ``cat-file --batch-check`` lines; type and size None where missing."""
    if raw and not raw.endswith(b"\n"):
        raise GitAnswerRefused("the answer isn't terminated")
    out = []
    for line in raw.decode().split("\n")[:-1]:
        parts = line.split(" ")
        if parts[-1] == "missing":
            out.append((" ".join(parts[:-1]), None, None))
        elif len(parts) == 3 and parts[2].isdigit():
            out.append((parts[0], parts[1], int(parts[2])))
        else:
            raise GitAnswerRefused(f"no batch-check line: {line}")
    return out


def blob_chunks(root: str, oids: list[str], most: int = 64 << 20) -> Iterator[dict[str, bytes | None]]:
    """Objects in chunks of about ``most`` bytes: sizes first, then one batch a chunk."""
    sizes = parse_batch_check(git(root, "cat-file", "--batch-check", data="".join(f"{o}\n" for o in sorted(set(oids))).encode())) if oids else []
    chunk, held = [], 0
    for name, _, size in [*sizes, (None, None, 0)]:
        if chunk and (name is None or held + (size or 0) > most):
            yield dict(zip(chunk, parse_batch(git(root, "cat-file", "--batch", data="".join(f"{o}\n" for o in chunk).encode()), len(chunk))))
            chunk, held = [], 0
        chunk.append(name)
        held += size or 0


def blobs(root: str, oids: list[str]) -> dict[str, bytes | None]:
    return {k: v for chunk in blob_chunks(root, oids) for k, v in chunk.items()}


def staged_text(root: str, path: str) -> str:
    """A file's text as staged."""
    return git(root, "show", f":./{path}").decode()


def head(root: str, ref: str = "HEAD") -> str | None:
    """Object of a ref, None before the first commit."""
    return ask(root, "rev-parse", "-q", "--verify", ref)


def top_level(root: str) -> str | None:
    return ask(root, "rev-parse", "--show-toplevel")


def is_shallow(root: str) -> bool:
    return ask(root, "rev-parse", "--is-shallow-repository") == "true"


def root_names(root: str, rev: str) -> list[str]:
    """Names at the top of a tree."""
    return _fields(git(root, "ls-tree", "--full-tree", "--name-only", "-z", rev))


def object_type(root: str, spec: str) -> str | None:
    return ask(root, "cat-file", "-t", spec)


def line_count(root: str, spec: str) -> int:
    """Lines of a blob; a last line without a line feed counts."""
    raw = git(root, "cat-file", "-p", spec)
    return raw.count(b"\n") + bool(raw and not raw.endswith(b"\n"))


def checkout(root: str) -> tuple[str | None, bool]:
    """(commit of HEAD, whether anything differs from it)."""
    lines = _fields(git(root, "status", "--porcelain=v2", "-z", "--branch"))
    oid = next((x.split(" ", 2)[2] for x in lines if x.startswith("# branch.oid ")), "(initial)")
    return (None if oid == "(initial)" else oid), any(not x.startswith("#") for x in lines)


def commit_known(root: str, rev: str) -> bool:
    return subprocess.run(["git", "-C", root, "rev-parse", "-q", "--verify", f"{rev}^{{commit}}"], capture_output=True, timeout=TIMEOUT).returncode == 0


def is_ancestor(root: str, a: str, b: str = "HEAD") -> bool:
    return subprocess.run(["git", "-C", root, "merge-base", "--is-ancestor", a, b], capture_output=True, timeout=TIMEOUT).returncode == 0


def commits_behind(root: str, a: str, b: str = "HEAD") -> int:
    return int(git(root, "rev-list", "--count", f"{a}..{b}"))


def changed_since(root: str, rev: str, covers: list[str]) -> list[str]:
    specs = [f":(top,literal){c.rstrip('/')}" for c in covers]
    return _fields(git(root, "diff", "--name-only", "-z", "--no-renames", rev, "HEAD", "--", *specs))


def _trees(root: str, specs: list[str]) -> list[str | None]:
    """Objects of names, None where missing, in one process."""
    told = parse_batch_check(git(root, "cat-file", "--batch-check", data="".join(f"{x}\n" for x in specs).encode())) if specs else []
    return [name if kind else None for name, kind, _ in told]


def _names_of(raw: bytes, width: int) -> list[str]:
    """Names in a tree object whose entries end in an object id of so many bytes."""
    out, at = [], 0
    while at < len(raw):
        end = raw.index(b"\0", at)
        out.append(raw[raw.index(b" ", at) + 1 : end].decode())
        at = end + 1 + width
    return out


def commits(root: str, names: list[str], tip: str) -> dict[str, tuple]:
    """Of each name of a commit: (object, whether ``tip`` has it, commits since, paths changed since, names at its top).

    A process for the objects, one for the history, one for the trees, one for all differences and one for all top
    levels, whatever the number of names.
    """
    full = dict(zip(names, _trees(root, [f"{n}^{{commit}}" for n in names]), strict=True))
    parents = {c: p for c, *p in (line.split(" ") for line in git(root, "rev-list", "--parents", tip).decode().splitlines())}
    known = sorted({c for c in full.values() if c in parents})
    trees = dict(zip([*known, tip], _trees(root, [f"{c}^{{tree}}" for c in [*known, tip]]), strict=True))
    heads = {t: f"{t} {trees[tip]}\n".encode() for t in dict.fromkeys(trees[c] for c in known)}
    raw, changed, at = git(root, "diff-tree", "-r", "-z", "--name-only", "--no-renames", "--stdin", data=b"".join(heads.values())) if heads else b"", {}, 0
    for (tree, head_), after in zip(heads.items(), [*list(heads.values())[1:], None], strict=True):
        if not raw.startswith(head_, at):
            raise GitAnswerRefused("the differences don't follow the question")
        end = raw.find(after, at + len(head_)) if after else len(raw)
        changed[tree], at = _fields(raw[at + len(head_) : end]), end
    top = blobs(root, [trees[c] for c in known])

    def since(commit: str) -> int:
        seen, todo = {commit}, [commit]
        while todo:
            new = [p for p in parents.get(todo.pop(), ()) if p not in seen]
            seen.update(new)
            todo += new
        return len(parents) - len(seen)

    behind = {c: since(c) for c in known}
    return {n: (c, True, behind[c], changed[trees[c]], _names_of(top[trees[c]], len(c) // 2)) if c in behind else (c, False, None, None, None) for n, c in full.items()}


def kinds(root: str, specs: list[str]) -> list[tuple[str | None, int]]:
    """(kind, lines) of each commit:path, None where missing: one process for the kinds, one a chunk for the blobs."""
    told = parse_batch_check(git(root, "cat-file", "--batch-check", data="".join(f"{x}\n" for x in specs).encode())) if specs else []
    lines = {}
    for chunk in blob_chunks(root, [name for name, kind, _ in told if kind == "blob"]):
        lines |= {k: v.count(b"\n") + bool(v and not v.endswith(b"\n")) for k, v in chunk.items() if v is not None}
    return [(kind, lines.get(name, 0)) for name, kind, _ in told]


def pin_state(root: str, commit: str, covers: list[str]) -> tuple[str, int | None]:
    """(state, commits behind): unknown, current, unchanged or stale."""
    if not commit_known(root, commit) or not is_ancestor(root, commit):
        return "unknown", None
    behind = commits_behind(root, commit)
    touched = changed_since(root, commit, covers)
    return ("stale" if touched else "current" if behind == 0 else "unchanged"), behind


def _rows(spark: SparkSession, root: str, entries, roots: list[str], prefix: str = "") -> DataFrame:
    """(path, content) of the pages among entries; paths are relative to ``prefix``. Executors read the objects where they reach the repository, in chunks."""
    cut = f"{prefix}/" if prefix else ""
    own = [(unicodedata.normalize("NFC", p[len(cut) :]), o) for mode, o, p in entries if p.startswith(cut) and p.endswith(".md") and mode[:3] == "100" and any(p[len(cut) :].startswith(r + "/") for r in roots)]
    listed = spark.createDataFrame(own, "path string, oid string")

    def read(frames):
        import pandas as pd

        for f in frames:
            for chunk in blob_chunks(root, f["oid"].tolist()):
                part = f[f["oid"].isin(chunk)]
                yield pd.DataFrame({"path": part["path"], "content": [chunk[o] or b"" for o in part["oid"]]})

    return listed.mapInPandas(read, "path string, content binary")


def prefix_of(root: str) -> str:
    """The directory inside its repository, "" at the top."""
    return (ask(root, "rev-parse", "--show-prefix") or "").rstrip("/")


def disagreements(index: DataFrame, base: DataFrame, named: DataFrame) -> DataFrame:
    """(path, side) where the listings (path, oid, mode) of index and HEAD and the paths that the diff names don't tell the same story."""
    a = index.select("path", F.struct("oid", "mode").alias("_a"))
    b = base.select("path", F.struct("oid", "mode").alias("_b"))
    differ = a.join(b, "path", "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("path")
    own = named.select("path").distinct()
    return differ.join(own, "path", "left_anti").withColumn("side", F.lit("not-named")).union(own.join(differ, "path", "left_anti").withColumn("side", F.lit("not-differing")))


def revision_state(spark: SparkSession, root: str, rev: str, content_roots: list[str]) -> DataFrame:
    return _rows(spark, root, tree_entries(root, rev), content_roots, prefix_of(root))


def removed_pages(spark: SparkSession, root: str, content_roots: list[str]) -> DataFrame:
    """(path, content) of the pages at HEAD that the staged diff deletes."""
    prefix = prefix_of(root)
    gone = {f"{prefix}/{p}" if prefix else p for s, p, _ in staged(root) if s == "D"}
    return _rows(spark, root, [x for x in tree_entries(root, "HEAD") if x[2] in gone] if gone else [], content_roots, prefix)


def index_state(spark: SparkSession, root: str, content_roots: list[str]) -> DataFrame:
    """(path, content, base_content, renamed_from): the index against HEAD; a rename keeps its source as base.

    Before the first commit no page has a base. A listing that the staged diff doesn't explain raises GitAnswerRefused.
    """
    prefix, entries = prefix_of(root), index_entries(root)
    cut = len(prefix) + 1 if prefix else 0
    now = _rows(spark, root, [(m, o, p) for m, o, p in ((m, o, f"{prefix}/{p}" if prefix else p) for m, o, p in entries)], content_roots, prefix)
    changes = staged(root)
    moved = spark.createDataFrame([(unicodedata.normalize("NFC", p), unicodedata.normalize("NFC", o)) for s, p, o in changes if s == "R"], "path string, renamed_from string")
    if head(root) is None:
        return now.withColumns({"base_content": F.lit(None).cast("binary"), "renamed_from": F.lit(None).cast("string")})
    at_head = [(m, o, p[cut:]) for m, o, p in tree_entries(root, "HEAD") if not prefix or p.startswith(prefix + "/")]
    listing = "mode string, oid string, path string"
    odd = disagreements(spark.createDataFrame(entries, listing), spark.createDataFrame(at_head, listing), spark.createDataFrame([(x,) for s, p, o in changes for x in (p, o if s == "R" else None) if x], "path string")).first()
    if odd:
        raise GitAnswerRefused(f"{odd.path}: the staged diff and the listings disagree ({odd.side})")
    base = revision_state(spark, root, "HEAD", content_roots).select(F.col("path").alias("base_path"), F.col("content").alias("base_content"))
    return now.join(moved, "path", "left").join(base, F.coalesce("renamed_from", "path") == F.col("base_path"), "left").drop("base_path")

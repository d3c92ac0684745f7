"""Identity keys, tokens, name forms and format predicates as columns.

The identity key is NFC(full case fold(NFD(s))). Texts of ASCII and precomposed
Latin-1 letters, where that is lower case with the sharp s spelt out, stay in
built-in functions; only other texts reach an Arrow function.
"""

from __future__ import annotations

import itertools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Characters between tokens.
SEPARATORS = "[\\x{09}-\\x{0d}\\x{20}-\\x{2f}\\x{3a}-\\x{40}\\x{5b}-\\x{60}\\x{7b}-\\x{7e}\\x{85}\\x{a0}\\x{ad}\\x{b7}\\x{2000}-\\x{206f}\\x{3000}-\\x{303f}]+"
#: Han ranges.
HAN = "\\x{3005}\\x{3007}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{20000}-\\x{3134f}"
#: Spaces (category Zs) at the ends of a text.
_SPACES = r"^\p{Zs}+|\p{Zs}+\z"
_SIMPLE = "^[\\x{00}-\\x{7f}\\x{a0}-\\x{b4}\\x{b6}-\\x{ff}]*$"


def _py(pattern: str) -> re.Pattern:
    wide = lambda m: f"\\U{int(m[1], 16):08x}"
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", wide, pattern))


_SEP_PY, _HAN_PY, _OTHER_PY = _py(SEPARATORS), _py(f"[{HAN}]+"), re.compile("[^\\x00-\\x7f\\xa0-\\xb4\\xb6-\\xff]")


def fold(text: str) -> str:
    if not _OTHER_PY.search(text):  # as in ``ident``
        return text.lower().replace("ß", "ss")
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).casefold())


def tokenize(text: str) -> list[str]:
    """Tokens in order: Han runs as characters, then as pairs; other runs as words."""
    out, text = [], fold(text)
    if not _HAN_PY.search(text):
        return [run for run in _SEP_PY.split(text) if run]
    for run in _SEP_PY.split(text):
        at = 0
        for m in _HAN_PY.finditer(run):
            if run[at : m.start()]:
                out.append(run[at : m.start()])
            out += [*m[0], *(m[0][k : k + 2] for k in range(len(m[0]) - 1))]
            at = m.end()
        if run[at:]:
            out.append(run[at:])
    return out


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(fold, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _tokenize(s: pd.Series) -> pd.Series:
    return s.map(tokenize, na_action="ignore")


def ident(col) -> Column:
    """Identity key; null stays null."""
    col = F.col(col) if isinstance(col, str) else col
    simple = col.rlike(_SIMPLE)
    return F.when(simple, F.replace(F.lower(col), F.lit("ß"), F.lit("ss"))).otherwise(_fold(F.when(~simple, col)))


def tokens(col) -> Column:
    """Tokens of a text, in order, repeats kept; null has none."""
    col = F.col(col) if isinstance(col, str) else col
    simple = col.rlike(_SIMPLE)
    own = F.filter(F.split(F.replace(F.lower(col), F.lit("ß"), F.lit("ss")), SEPARATORS, -1), lambda x: x != "")
    return F.coalesce(F.when(simple, own).otherwise(_tokenize(F.when(~simple, col))), F.array().cast("array<string>"))


def compact(col) -> Column:
    """Identity key without separators."""
    return F.regexp_replace(ident(col), SEPARATORS, "")


def has_han(col) -> Column:
    return F.col(col).rlike(f"[{HAN}]") if isinstance(col, str) else col.rlike(f"[{HAN}]")


def trigrams(col: Column) -> Column:
    """Distinct code point triples of the text between two spaces."""
    chars = F.split(F.concat(F.lit(" "), col, F.lit(" ")), "")
    triple = lambda c: F.transform(F.slice(c, F.lit(1), F.size(c) - 2), lambda x, i: F.concat(x, F.get(c, i + 1), F.get(c, i + 2)))
    # the characters are bound by a lambda, or they would be split again for each triple
    grams = F.flatten(F.transform(F.array(chars), triple))
    return F.when(F.length(col) < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """0 when either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def text_similarity(a: Column, b: Column) -> Column:
    """Trigram Jaccard of two texts as they stand; 1 when neither has a trigram."""
    x, y = trigrams(a), trigrams(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).otherwise(jaccard(x, y))


def utf16_length(col: Column) -> Column:
    return F.length(col) + F.length(F.regexp_replace(col, "[^\\x{10000}-\\x{10ffff}]", ""))


def strip_qualifier(col: Column) -> Column:
    """The name before its last trailing " (...)"; null if there is none."""
    stem = F.rtrim(F.regexp_extract(F.rtrim(col), r"(?s)^(.+) \(.*\)$", 1))
    return F.when(stem != "", stem)


def basename(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")


def claim_handle(core: Column) -> Column:
    return F.concat(F.lit("#"), F.substring(F.sha2(ident(core), 256), 1, 8))


def digit_signature(core: Column) -> Column:
    return F.regexp_replace(core, r"[^\p{Nd}]", "")


def within_edits(a: Column, b: Column, most: int = 3) -> Column:
    return F.levenshtein(a, b, most) >= 0


def is_date(col: Column) -> Column:
    return F.coalesce(col.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(col, "yyyy-MM-dd").isNotNull(), F.lit(False))


def is_date_time(col: Column) -> Column:
    """RFC 3339 with an offset; second 60 is allowed."""
    shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ]([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$"
    return F.coalesce(col.rlike(shape) & is_date(F.substring(col, 1, 10)), F.lit(False))


def precision(col: Column) -> Column:
    """day, month or year of a dated entry; null if it is none."""
    month = col.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$")
    return F.when(is_date(col), "day").when(month, "month").when(col.rlike(r"^[0-9]{4}$"), "year")


def parse_uri(col: Column) -> Column:
    """struct<scheme, host, path>: lower-case host, port kept unless it is the scheme's own; null if not absolute."""
    scheme = F.lower(F.regexp_extract(col, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    own = F.when(scheme == "https", ":443$").when(scheme == "http", ":80$").otherwise(":$")
    path = F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)
    path = F.when((path == "") & scheme.isin("http", "https"), "/").otherwise(path)
    valid = (scheme != "") & ~col.rlike(r"\s") & (~scheme.isin("http", "https") | (rest != ""))
    return F.when(valid, F.struct(scheme.alias("scheme"), F.regexp_replace(F.lower(rest), own, "").alias("host"), path.alias("path")))


def lede(body: Column) -> Column:
    """First line that is neither blank nor a heading, without the spaces around it."""
    # trim bare would take the line's number, transform's second argument, as the characters to cut
    return F.get(F.filter(F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, _SPACES, "")), lambda x: (x != "") & ~x.startswith("#")), 0)


def path_refusal(path: Column) -> Column:
    """The first reason for which a path is refused, null if none. A drive or share is named before the absolute path that it also is; segments are read left to right."""
    kind = lambda x: F.when(x == "", "empty-segment").when(x == ".", "dot-segment").when(x == "..", "traversal")
    segment = F.get(F.filter(F.transform(F.split(path, "/"), kind), lambda x: x.isNotNull()), 0)
    return (
        F.when(path.isNull() | (path == ""), "empty").when(path.rlike("^[A-Za-z]:"), "drive").when(path.rlike(r"^(\\\\|//)"), "unc")
        .when(path.startswith("/"), "absolute").when(path.contains("\\"), "backslash").when(path.rlike(r"[\x{00}-\x{1f}\x{7f}]"), "control-character")
        .when(path.endswith("/"), "trailing-slash").otherwise(segment)
    )


def refused_path(path: str) -> str | None:
    """``path_refusal`` of one path, on the driver."""
    for pattern, reason in ((r"^$", "empty"), (r"^[A-Za-z]:", "drive"), (r"^(\\\\|//)", "unc"), (r"^/", "absolute"), (r"\\", "backslash"), (r"[\x00-\x1f\x7f]", "control-character"), (r"/\Z", "trailing-slash")):
        if re.search(pattern, path):
            return reason
    return next((r for x in path.split("/") if (r := {"": "empty-segment", ".": "dot-segment", "..": "traversal"}.get(x))), None)


def code_units(col: Column) -> Column:
    """Sort key of a text in the order of its UTF-16 code units, which puts characters beyond the first plane before U+E000."""
    return F.encode(col, "UTF-16BE")


def is_content_path(path: Column, roots: list[str]) -> Column:
    under = F.exists(F.array(*map(F.lit, roots)), lambda r: path.startswith(F.concat(r, F.lit("/"))))
    return path_refusal(path).isNull() & under & path.endswith(".md")


def folder_segments(path: Column, root: str) -> Column:
    inside = F.split(F.substring(path, F.lit(len(root) + 2), F.length(path)), "/")
    return F.slice(inside, F.lit(1), F.greatest(F.size(inside) - 1, F.lit(0)))


def segment_identity(col: Column) -> Column:
    return ident(F.regexp_replace(col, r"[\s_]+", "-"))


def retract_clause(day: Column) -> Column:
    return F.concat(F.lit("retracted "), day)


def supersede_clause(day: Column, by: Column) -> Column:
    return F.concat(F.lit("valid →"), day_before(day), F.lit(", superseded "), day, F.lit(" by "), by)


def day_before(day: Column) -> Column:
    return F.date_format(F.date_sub(F.to_date(day, "yyyy-MM-dd"), 1), "yyyy-MM-dd")


def commit_prefix(message: Column) -> Column:
    """Prefix of a message whose first line opens with "name:", "name(scope):" or "name!:"; none otherwise."""
    found = F.regexp_extract(F.trim(F.split(message, "\n")[0]), r"^([A-Za-z][A-Za-z0-9-]*)(?:\([^()]+\))?!?:", 1)
    return F.when(found == "", "none").otherwise(found)


def law_change_reason(message: Column) -> Column:
    """Reason of the first line "law-change: reason" after the subject, comment lines aside; null if there is none."""
    lines = F.filter(F.transform(F.split(message, "\n"), lambda x: F.regexp_replace(x, r"\r$", "")), lambda x: ~x.startswith("#"))
    said = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), lambda x: x.rlike(r"^law-change:[ \t]*\S"))
    return F.trim(F.regexp_extract(F.get(said, 0), r"^law-change:[ \t]*(\S.*)$", 1))


def table_cell(col: Column) -> Column:
    return F.replace(F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def pointer_key(pointer: Column) -> Column:
    """First key of a JSON pointer, its escapes read."""
    return F.replace(F.replace(F.get(F.split(pointer, "/"), 1), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def normalized(raw: Column) -> Column:
    """struct<text, mark, crlf>: the text without byte order mark and with bare line feeds, and whether it had them."""
    mark = raw.startswith("\ufeff")
    body = F.when(mark, F.substring(raw, F.lit(2), F.length(raw))).otherwise(raw)
    return F.struct(F.replace(body, F.lit("\r\n"), F.lit("\n")).alias("text"), mark.alias("mark"), body.contains("\r\n").alias("crlf"))


@F.pandas_udf(ArrayType(StructType([StructField(x, IntegerType()) for x in ("line", "start", "end")])))
def _byte_spans(text: pd.Series) -> pd.Series:
    out = []
    for t in text:
        ends = itertools.accumulate(len(x.encode()) + 1 for x in (t or "").split("\n"))
        starts = itertools.chain([0], ends)
        out.append(None if t is None else [{"line": k, "start": a, "end": b - 1} for k, (a, b) in enumerate(itertools.pairwise(starts), 1)])
    return pd.Series(out)


def byte_spans(text: Column) -> Column:
    """Array of struct<line, start, end>: byte offsets of each line, its end exclusive of the line feed; in time linear in the text."""
    return _byte_spans(text)


def canonical_json(value) -> str:
    """JSON with keys in code unit order, integers as digits and floats as ECMAScript writes them."""
    import json

    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: str(k).encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(str(k), ensure_ascii=False)}:{canonical_json(value[k])}" for k in keys) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return "null"
        if value.is_integer() and abs(value) < 1e21:
            return str(int(value))
        mantissa, e, power = repr(value).partition("e")
        if not e:
            return mantissa
        return _plain(value) if -7 < int(power) < 0 else f"{mantissa.removesuffix('.0')}e{int(power):+d}"
    if value is None or isinstance(value, (bool, int, str)):
        return json.dumps(value, ensure_ascii=False)
    return json.dumps(str(value), ensure_ascii=False)


def _plain(value: float) -> str:
    from decimal import Decimal

    return format(Decimal(repr(value)), "f")


@F.pandas_udf(StringType())
def _page_head(front: pd.Series, meta: pd.Series) -> pd.Series:
    import json

    return pd.Series([canonical_json({k: v for k, v in json.loads(f or "{}").items() if k not in (m if m is not None else ())}) for f, m in zip(front, meta)])


def page_digest(front: Column, meta: Column, body: Column) -> Column:
    """SHA-256 of the canonical frontmatter (JSON) without its meta keys, a NUL and the body."""
    return F.sha2(F.concat(_page_head(front, meta), F.lit("\0"), body).cast("binary"), 256)


def satisfies(version: str, wanted: str) -> bool:
    """Whether a version lies in a range of space-separated comparators (< <= > >= = ^ ~); an unreadable term is false."""
    read = lambda x: tuple(map(int, m.groups())) if (m := re.fullmatch(r"(\d+)\.(\d+)\.(\d+)(?:[-+].*)?", x)) else None
    own, terms = read(version), wanted.split()
    if own is None or not terms:
        return False
    for term in terms:
        op, at = re.fullmatch(r"(>=|<=|[<>=^~])?(.*)", term).groups()
        at = read(at)
        if at is None:
            return False
        above = (at[0], at[1] + 1, 0) if op == "~" or at[0] == 0 else (at[0] + 1, 0, 0)
        if not {"<": own < at, "<=": own <= at, ">": own > at, ">=": own >= at, "^": at <= own < above, "~": at <= own < above}.get(op, own == at):
            return False
    return True


def today(environment: str = "SCRIPTORIUM_TODAY") -> str:
    """The date that a run works with: read once, from the environment or the clock."""
    import datetime
    import os

    return os.environ.get(environment) or datetime.date.today().isoformat()

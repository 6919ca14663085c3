"""Text predicates and scalar functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _java_quote(s: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", s)


def has_all_words(hay: Column, words: list[str]) -> Column:
    """True if every word is in the text, letter case aside; true without words."""
    out = F.lit(True)
    low = F.lower(hay)
    for w in words:
        out = out & F.contains(low, F.lit(w.lower()))
    return out


def word_start(hay: Column, needle: str) -> Column:
    """True if the needle begins at the start of a word; letters, marks and digits make words."""
    return F.lower(hay).rlike(r"(^|[^\p{L}\p{M}\p{N}])" + _java_quote(needle.lower()))


def mentions(hay: Column, term: str) -> Column:
    """True if an alternative of ``a|b|c`` is mentioned; those under four characters or without letters need boundaries."""
    low, out = F.lower(hay), F.lit(False)
    for part in filter(None, (p.strip().lower() for p in term.split("|"))):
        if len(part) < 4 or not re.search("[a-z]", part):
            out = out | low.rlike(f"(^|[^a-z0-9]){_java_quote(part)}($|[^a-z0-9])")
        else:
            out = out | F.contains(low, F.lit(part))
    return out


def safe_path(path: Column) -> Column:
    """True for a relative path of plain segments: no leading slash, backslash, empty, ``.`` or ``..`` part."""
    parts = F.split(path, "/")
    plain = F.forall(parts, lambda s: ~s.isin("", ".", ".."))
    return (path != "") & ~F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("\\")) & plain


def slug(name: Column) -> Column:
    """Lower-case words joined by hyphens; camel case is split; ``x`` when nothing is left."""
    s = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1-$2")
    s = F.regexp_replace(s, r"([A-Z]+)([A-Z][a-z])", "$1-$2")
    s = F.regexp_replace(F.lower(s), r"[^a-z0-9]+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.when(s == "", "x").otherwise(s)


def typed_id(prefix: str, *parts: Column) -> Column:
    """Prefix and slugs of the parts, joined by colons."""
    return F.concat_ws(":", F.lit(prefix), *map(slug, parts))


def bound_id(ident: Column, most: int = 192) -> Column:
    """An id of at most ``most`` characters; a longer one ends in 16 digits of its SHA-256."""
    tail = F.substring(F.sha2(ident, 256), 1, 16)
    return F.when(F.length(ident) <= most, ident).otherwise(F.concat(F.substring(ident, 1, most - 17), F.lit("-"), tail))


#: Shapes of credentials, account ids and addresses, most specific first.
SECRETS = (
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[redacted]"),
    (r"gh[pousr]_[A-Za-z0-9]{20,}", "[redacted-token]"),
    (r"github_pat_[A-Za-z0-9_]{20,}", "[redacted-token]"),
    (r"glpat-[A-Za-z0-9_-]{20,}", "[redacted-token]"),
    (r"npm_[A-Za-z0-9]{36}", "[redacted-token]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[redacted]"),
    (r"(?i)\bBearer\s+(?!\[redacted)[A-Za-z0-9._~+/=-]{8,}", "Bearer [redacted]"),
    (r"\bsk-[A-Za-z0-9_-]{16,}", "[redacted-key]"),
    (r"\b(?:user|org|acct|account|proj)_(?=[A-Za-z0-9]*[0-9])(?:(?=[A-Za-z0-9]*[A-Z])[A-Za-z0-9]{16,}|[A-Za-z0-9]{20,})\b", "[redacted-id]"),
    (r"\buser-(?=[A-Za-z0-9]*[0-9])(?=[A-Za-z0-9]*[A-Z])[A-Za-z0-9]{16,}\b", "[redacted-id]"),
    (r"\borg-(?:(?=[A-Za-z0-9]*[0-9A-Z])[A-Za-z0-9]{12,}|[A-Za-z0-9]{20,})\b", "[redacted-id]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?=[.-]*(?:[^A-Za-z0-9.-]|$))", "[redacted-email]"),
    (r"(?i)\b(token|secret|password)(\s*[=:]\s*)[\x22\x27]?[A-Za-z0-9_\-./+]{8,}[\x22\x27]?", "$1$2[redacted]"),
    (r"(/Users|/home)/[A-Za-z0-9._-]+", "$1/[user]"),
)

_HOST_TOKENS = tuple(s for s in SECRETS if s[0].startswith(("gh[", "github_")))


def holds_token(text: Column) -> Column:
    """Whether a text holds an access token of a code host."""
    return text.rlike("|".join(pattern for pattern, _ in _HOST_TOKENS))


def mask_tokens(text: Column) -> Column:
    """Access tokens of code hosts masked; all else stays."""
    for pattern, by in _HOST_TOKENS:
        text = F.regexp_replace(text, pattern, by)
    return text


def plain_controls(text: Column, by: str = " ") -> Column:
    """Control characters replaced."""
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", by)


def package_name(specifier: Column) -> Column:
    """npm package of an import specifier: scope and name, or the first segment; null for relative and built-in ones."""
    parts = F.split(specifier, "/")
    scoped = F.when(F.size(parts) >= 2, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    local = specifier.rlike(r"^(\.|/|node:|#)")
    return F.when(local | (specifier == ""), None).when(F.startswith(specifier, F.lit("@")), scoped).otherwise(F.get(parts, F.lit(0)))


def coverage_path(path: Column) -> Column:
    """Forward slashes, no leading ``./`` and no doubled slashes."""
    s = F.regexp_replace(F.trim(path), r"\\", "/")
    s = F.regexp_replace(s, r"/{2,}", "/")
    return F.regexp_replace(s, r"^(\./)+", "")


#: Language of a file by its ending.
LANGUAGES = {".tsx": "tsx", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".rs": "rust"}


def file_language(path: Column) -> Column:
    """Language by the file's ending; null for others."""
    out = F.lit(None).cast("string")
    for end, lang in LANGUAGES.items():
        out = F.when(F.endswith(F.lower(path), F.lit(end)), lang).otherwise(out)
    return out


def shorten(text: Column, most: int) -> Column:
    """At most ``most`` characters with an ellipsis, cut after a word where one ends in the last third."""
    cut = F.substring(text, F.lit(1), F.lit(most - 1))
    at_word = F.regexp_replace(cut, r"\s+\S*$", "")
    body = F.when(F.length(at_word) >= (most * 2) // 3, at_word).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(body), F.lit("…")))


def content_hash(*cols: str) -> Column:
    """SHA-256 of the canonical JSON of the columns, keys in ascending order, nulls left out."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))), 256)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def round4(x: Column) -> Column:
    """Half up to four decimals."""
    return F.floor(x.cast("double") * 10000 + F.lit(0.5).cast("double")).cast("double") / 10000


def mermaid_label(text: Column) -> Column:
    """A label that a diagram can hold: quotes, brackets and line ends escaped."""
    s = F.regexp_replace(text, r"[\r\n]+", " ")
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def mermaid_id(text: Column) -> Column:
    """An identifier of letters, digits and underscores."""
    s = F.regexp_replace(text, r"[^A-Za-z0-9_]", "_")
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("n"), s)).otherwise(s)


#: A string literal, and a comment, of the languages that are read here.
_STRING = r"\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|`[^`\\]*(?:\\.[^`\\]*)*`"
_COMMENT = r"//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"


def without_comments(code: Column, rust: bool = False) -> Column:
    """Source code without its comments; what looks like one inside a string stays. In Rust only double quotes hold strings."""
    return F.regexp_replace(code, f"({_STRING.split('|')[0] if rust else _STRING})|{_COMMENT}", "$1")


def code_only(code: Column) -> Column:
    """Source code with comments gone and string literals emptied."""
    return F.regexp_replace(F.regexp_replace(code, f"({_STRING})|{_COMMENT}", "$1"), _STRING, '""')


def branch_count(code: Column) -> Column:
    """1 and the branches of a piece of code: keywords and short-circuit operators outside comments and strings."""
    plain = code_only(code)
    return 1 + F.regexp_count(plain, F.lit(r"\b(if|for|while|case|catch)\b")) + F.regexp_count(plain, F.lit(r"&&|\|\||\?\?"))


def types_target(name: Column) -> Column:
    """The package that a ``@types/`` package describes, scopes included; null for others."""
    inner = F.regexp_extract(name, "^@types/(.+)$", 1)
    scoped = F.concat(F.lit("@"), F.regexp_extract(inner, "^([^_]+)__(.+)$", 1), F.lit("/"), F.regexp_extract(inner, "^([^_]+)__(.+)$", 2))
    return F.when(inner != "", F.when(inner.rlike("^[^_]+__.+$"), scoped).otherwise(inner))


def name_matches(name: Column, wanted: Column, ecosystem: Column) -> Column:
    """True for the wanted package itself, the one whose types it holds, and for crates that differ by hyphens only."""
    ident = lambda c: F.translate(c, "-", "_")
    return (name == wanted) | F.coalesce(name == types_target(wanted), F.lit(False)) | ((ecosystem == "cargo") & (ident(name) == ident(wanted)))


def test_data_path(path: Column) -> Column:
    """True below a directory that holds test data by convention."""
    return path.rlike(r"(^|/)testdata/")


def service_boundary(package: Column, library_scopes: list[str], libraries: list[str], service_scopes: list[str], services: list[str]) -> Column:
    """True for a package that stands for another system: listed services, and SDKs and API clients by their names.

    Libraries are named first and win; ``react-`` and ``lodash.`` packages are libraries.
    """
    scope, bare = F.regexp_extract(package, "^(@[^/]+)", 1), F.regexp_replace(package, "^@[^/]*/", "")
    library = scope.isin(*library_scopes) | package.isin(*libraries) | bare.isin(*libraries) | bare.rlike(r"^(react-|lodash\.)")
    service = scope.isin(*service_scopes) | package.isin(*services) | bare.isin(*services)
    named = package.rlike("(?i)(?:^|/|-)sdk$") | bare.rlike("(?i)(?:^|/)sdk(?:-|$)") | bare.rlike("-api-client$")
    return ~library & (service | named)


#: Endings of test files, in the order in which they are looked for.
TEST_ENDINGS = (
    ".test.ts", ".test.tsx", ".spec.ts", ".spec.tsx", ".test.mts", ".spec.mts", ".test.cts", ".spec.cts",
    ".test.mjs", ".spec.mjs", ".test.cjs", ".spec.cjs", ".test.js", ".spec.js", ".test.jsx", ".spec.jsx",
)


def test_paths(path: Column) -> Column:
    """Where tests of a source file may lie: beside it, then in ``__tests__``; null if it is no script."""
    folder = F.regexp_extract(path, "^(.*/)?[^/]*$", 1)
    stem = F.regexp_extract(path, r"^(?:.*/)?([^/]+)\.[cm]?[jt]sx?$", 1)
    made = F.array(*(F.concat(folder, F.lit(between), stem, F.lit(end)) for between in ("", "__tests__/") for end in TEST_ENDINGS))
    return F.when(stem != "", made)


#: Advances in thousandths of an em of the characters from blank to tilde and of the ellipsis, sans regular.
SANS_ADVANCES = (
    236, 284, 419, 713, 598, 927, 694, 242, 335, 335, 450, 600, 272, 399, 272, 383,
    600, 600, 600, 600, 600, 600, 600, 600, 600, 600, 292, 292, 600, 600, 600, 477,
    891, 641, 653, 621, 671, 583, 559, 695, 707, 400, 510, 634, 501, 812, 707, 708,
    606, 708, 640, 581, 572, 678, 609, 891, 613, 593, 580, 317, 383, 317, 600, 565,
    600, 534, 580, 503, 580, 549, 324, 528, 568, 250, 250, 527, 272, 873, 568, 560,
    580, 580, 367, 487, 351, 568, 492, 768, 507, 499, 464, 343, 314, 343, 600, 803,
)


def text_width(text: Column, advances: tuple[int, ...] = SANS_ADVANCES) -> Column:
    """Width in thousandths of the font size; characters that the table lacks are as wide as a question mark."""
    table = F.array(*map(F.lit, advances))
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    slot = lambda c: F.when(c == "…", len(advances)).when(F.ascii(c).between(32, 126), F.ascii(c) - 31).otherwise(ord("?") - 31)
    return F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: a + F.element_at(table, slot(c).cast("int")))


#: Bounds of a captured excerpt.
EXCERPT_LINES, EXCERPT_LINE_CHARS, EXCERPT_CHARS = 48, 512, 4096


def clamp_excerpt(text: Column, start: Column, end: Column, focus: Column | None = None) -> Column:
    """(start_line, lines) of the part of ``start`` to ``end`` (from 1) that an excerpt may hold; null where that is nothing.

    It begins eight lines before ``focus`` at the most. Overlong lines at its beginning are passed over, a later one ends
    it, and so do the bounds of lines and characters. Lines are never cut.
    """
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    last = F.least(F.size(lines), end)
    first = start if focus is None else F.greatest(start, focus - 8)
    asked = (start >= 1) & (start <= F.size(lines)) & (end >= start)
    if focus is not None:
        asked = asked & (focus.isNull() | focus.between(start, last))
    window = F.slice(lines, first, F.greatest(last - first + 1, F.lit(0)))
    none = F.struct(F.lit(0).alias("skipped"), F.lit(0).alias("taken"), F.lit(0).alias("chars"), F.lit(False).alias("over"))

    def step(s: Column, line: Column) -> Column:
        n = F.char_length(line)
        long, begun = n > EXCERPT_LINE_CHARS, s["taken"] > 0
        grown = s["chars"] + n + F.when(begun, 1).otherwise(0)
        over = s["over"] | (long & begun) | (~long & (grown > EXCERPT_CHARS)) | (s["taken"] >= EXCERPT_LINES)
        return F.struct(
            F.when(~over & long, s["skipped"] + 1).otherwise(s["skipped"]).alias("skipped"),
            F.when(~over & ~long, s["taken"] + 1).otherwise(s["taken"]).alias("taken"),
            F.when(~over & ~long, grown).otherwise(s["chars"]).alias("chars"),
            over.alias("over"),
        )

    got = F.aggregate(window, none, step)
    made = F.struct((first + got["skipped"]).alias("start_line"), F.slice(window, got["skipped"] + 1, got["taken"]).alias("lines"))
    return F.when(asked & (got["taken"] > 0), made)

"""Code as tokens: an automaton with a stack of brackets and templates, for scripts and for Rust.

Comments and blanks make no tokens. Each token knows the bracket that it stands in and the function that it runs in, so that
imports, declarations, copies and branches are DataFrame work over the rows (see ``operators.code_facts``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of tokens: name (identifiers and keywords), number, string, template (a piece of one), regex, lifetime, mark.
TOKEN_FIELDS = "at: int, kind: string, text: string, line: int, end_line: int, start: int, stop: int, depth: int, inside: int, partner: int, scope: int"

_SPACE = re.compile(r"\s+")
_SKIPPED = re.compile(r"(?:\s+|//[^\n]*|/\*(?:.*?\*/|.*))+", re.S)
_NAME = re.compile(r"#?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
_NUMBER = re.compile(r"\d(?:[eE][+-]\d|[\w.](?!\.))*")
_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
_MARK = re.compile(r"\.\.\.|=>|===|!==|\*\*=|\*\*|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[-+*/%&|^!=<]=|>=|->|::|.", re.S)
_RUST_NAME = re.compile(r"r#[A-Za-z_]\w*|[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*")
_RUST_CHAR = re.compile(r"b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^\\'\n])'")
_RUST_LIFETIME = re.compile(r"'[A-Za-z_]\w*")
_RUST_RAW = re.compile(r"b?r(#*)\"")
_RUST_STRING = re.compile(r"b?\"(?:\\.|[^\"\\])*\"?", re.S)

#: Words after which a slash begins a regular expression, and words before a bracket that make a block of it, not a function.
_BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else await yield".split())
_CONTROL = frozenset("if for while switch catch with".split())
#: Words that begin a statement on a line of their own.
STARTERS = frozenset("import export function class interface enum namespace module declare abstract const let var if for while do return throw switch try".split())
#: What may stand before a brace that opens a type.
_TYPE_POSITION = frozenset(": | & ( [ ? = < , extends keyof readonly".split())
#: Letters of names, and marks that are no part of longer ones.
_LETTERS, _SINGLE = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_$"), frozenset("()[]{;,")
_OPEN, _CLOSE = frozenset("([{"), {")": "(", "]": "[", "}": "{"}


def _comment_end(text: str, at: int) -> int:
    """Where the comment of Rust that begins at ``at`` ends, or ``at`` if none does."""
    if text.startswith("//", at):
        end = text.find("\n", at)
        return len(text) if end < 0 else end
    if not text.startswith("/*", at):
        return at
    depth, i = 1, at + 2
    for m in re.compile(r"/\*|\*/").finditer(text, i):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


class _Reader:
    """Reads one text; ``rows`` has its tokens as lists in the order of TOKEN_FIELDS."""

    def __init__(self, text: str, rust: bool):
        self.text, self.rust, self.rows, self.line, self.counted = text, rust, [], 1, 0
        self.open: list[int] = []  # brackets that stand open, as token numbers
        self.templates: list[int] = []  # how many brackets stood open where a template's ${ began
        self.scopes: list[tuple[int, int, str]] = []  # functions: (token number, brackets open there, "{" or "=>")
        self.classes: set[int] = set()  # bracket counts at which a class waits for its body
        self.typed: set[int] = set()  # bracket counts at which parameters were closed and a return type follows

    def _put(self, kind: str, start: int, stop: int) -> None:
        text, n = self.text, len(self.rows)
        line = end_line = self.line
        if start > self.counted:
            line = end_line = line + text.count("\n", self.counted, start)
        if kind != "name" and kind != "mark":  # these two lie in a line
            end_line += text.count("\n", start, stop)
        self.line, self.counted = end_line, stop
        word, partner, before = text[start:stop], None, self.rows[-1][2] if n else ""
        if kind == "mark" and word in _CLOSE or kind == "template" and word[0] == "}":
            while self.scopes and self.scopes[-1][2] == "=>" and self.scopes[-1][1] >= len(self.open):
                self.scopes.pop()
            if self.open:
                partner = self.open.pop()
                self.rows[partner][9] = n
            if self.scopes and self.scopes[-1][0] == partner:
                self.scopes.pop()
        elif not self.rust and self.scopes and self.scopes[-1][2] == "=>" and self.scopes[-1][1] == len(self.open):
            own_line = self.rows and line > self.rows[-1][4]
            if word in (",", ";") and kind == "mark" or own_line and kind == "name" and word in STARTERS:
                self.scopes.pop()
        scope = self.scopes[-1][0] if self.scopes else -1
        self.rows.append([n, kind, word, line, end_line, start, stop, len(self.open), self.open[-1] if self.open else -1, partner, scope])
        if self.rust or kind not in ("mark", "name"):
            if kind == "mark" and word in _OPEN or kind == "template" and word.endswith("${"):
                self.open.append(n)
            return
        depth = len(self.open)
        if kind == "name":
            if word == "class" and before != ".":
                self.classes.add(depth)
        elif word == "=>":
            self.scopes.append((n, depth, "=>"))
        elif word in _OPEN:
            if word == "{":
                self._brace(n, before, depth)
            self.open.append(n)
        elif word in (";", ","):
            self.typed.discard(depth)
        elif word == ":" and before == ")":
            self.typed.add(depth)

    def _brace(self, n: int, before: str, depth: int) -> None:
        """Whether a brace opens a function's or a class's body: one more scope."""
        if before == "=>" and self.scopes and self.scopes[-1][0] == n - 1:
            self.scopes[-1] = (n, depth, "{")
        elif depth in self.classes:
            self.classes.discard(depth)
            self.scopes.append((n, depth, "{"))
        elif before == ")":
            opener = self.rows[n - 1][9]
            word = self.rows[opener - 1][2] if opener else ""
            if word == "await" and opener > 1:
                word = self.rows[opener - 2][2]
            if word not in _CONTROL:
                self.scopes.append((n, depth, "{"))
        elif depth in self.typed and before not in _TYPE_POSITION:
            self.typed.discard(depth)
            while self.scopes and self.scopes[-1][1:] == (depth, "=>"):  # an arrow of the return type
                self.scopes.pop()
            self.scopes.append((n, depth, "{"))

    def _value_before(self) -> bool:
        """Whether a slash after the last token divides."""
        if not self.rows:
            return False
        kind, word = self.rows[-1][1], self.rows[-1][2]
        if kind == "name":
            return word not in _BEFORE_REGEX
        if word == ")":
            opener = self.rows[-1][9]
            return not (opener and self.rows[opener - 1][2] in _CONTROL)
        return kind in ("number", "string", "regex") or word in ("]", "}") or kind == "template" and word.endswith("`")

    def read(self) -> list[list]:
        text, at, end = self.text, 0, len(self.text)
        skipped, token = (_SPACE.match, self._rust_token) if self.rust else (_SKIPPED.match, self._script_token)
        while at < end:
            if m := skipped(text, at):
                at = m.end()
                continue
            if self.rust and (stop := _comment_end(text, at)) > at:
                at = stop
                continue
            kind, stop = token(at)
            self._put(kind, at, stop)
            if kind == "template" and text[stop - 2 : stop] == "${":
                self.templates.append(len(self.open))
            at = stop
        return self.rows

    def _piece(self, at: int) -> int:
        """The end of a piece of a template: past its backtick, or past the ${ of an expression."""
        stop = _TEMPLATE.match(self.text, at).end()
        return min(len(self.text), stop + (2 if self.text.startswith("${", stop) else 1))

    def _script_token(self, at: int) -> tuple[str, int]:
        text, c = self.text, self.text[at]
        if c in _LETTERS:
            return "name", _NAME.match(text, at).end()
        if c in _SINGLE:
            return "mark", at + 1
        if c == "`":
            return "template", self._piece(at + 1)
        if c == "}" and self.templates and self.templates[-1] == len(self.open):
            self.templates.pop()
            return "template", self._piece(at + 1)
        if c in "\"'":
            return "string", _STRING.match(text, at).end()
        if c.isdecimal() or c == "." and text[at + 1 : at + 2].isdecimal():
            return "number", _NUMBER.match(text, at + (c == ".")).end()
        if m := _NAME.match(text, at):
            return "name", m.end()
        if c == "/" and not self._value_before() and (m := _REGEX.match(text, at)):
            return "regex", m.end()
        return "mark", _MARK.match(text, at).end()

    def _rust_token(self, at: int) -> tuple[str, int]:
        text = self.text
        if m := _RUST_RAW.match(text, at):
            end = text.find('"' + m[1], m.end())
            return "string", len(text) if end < 0 else end + 1 + len(m[1])
        for kind, pattern in (("string", _RUST_STRING), ("string", _RUST_CHAR), ("lifetime", _RUST_LIFETIME), ("name", _RUST_NAME)):
            if m := pattern.match(text, at):
                return kind, m.end()
        if text[at].isdecimal():
            return "number", _NUMBER.match(text, at).end()
        return "mark", _MARK.match(text, at).end()


def read_tokens(text: str, rust: bool = False) -> list[list]:
    """Tokens of a text: [at, kind, text, line, end_line, start, stop, depth, inside, partner, scope].

    ``depth`` counts the brackets around a token, a bracket's own not among them (``${`` of a template is one); ``inside`` is the nearest of them and
    ``partner`` the other bracket of a pair. ``scope`` is the token that opens the function or class body around it (a brace or,
    of an arrow without one, the arrow); -1 outside. What is broken off, and brackets too many, still give tokens. Text
    between tags of a markup dialect is not told from code.
    """
    return _Reader(text, rust).read()


def code_tokens(files: DataFrame, rust: bool = False) -> DataFrame:
    """(path, tokens) of files (path, text): a row for each file, tokens as structs of TOKEN_FIELDS in their order. A null text has none.
    Files are read one by one where they lie: no shuffle.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        names = [f.split(":")[0] for f in TOKEN_FIELDS.split(", ")]
        kinds = [pa.int32(), pa.string(), pa.string(), *[pa.int32()] * 8]

        def made(paths: list, ends: list, rows: list) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(names)
            tokens = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens)], ["path", "tokens"])

        for b in batches:
            paths, ends, rows = [], [0], []
            for path, text in zip(b.column(0).to_pylist(), b.column(1)):
                rows += read_tokens(text.as_py() or "", rust)
                paths.append(path)
                ends.append(len(rows))
                if len(rows) > 20_000:  # what a worker holds stays small
                    yield made(paths, ends, rows)
                    paths, ends, rows = [], [0], []
            yield made(paths, ends, rows)

    return files.select(F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(run, f"path string, tokens array<struct<{TOKEN_FIELDS}>>")

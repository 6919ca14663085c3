"""Masking of what names or opens an account: values of keys, whole and balanced, and secrets in dependency specifiers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SECRETS, mask_tokens, plain_controls

#: Keys that name an account, as words with or without a sign between; True if any value goes, False if only one
#: that looks like an id.
KEYS = (
    (("user", "id"), True), (("user",), False), (("organi[sz]ation", "id"), True), (("organi[sz]ation",), True), (("org", "id"), True), (("account", "id"), True),
    (("account",), False), (("e-?mail", "address"), True), (("e-?mail",), True), (("api", "key"), True),
)
#: What stands for a value, and how far a list or object is followed.
MASK, REACH = "[redacted]", 8192

_NAMES = "|".join("[_-]?".join(words) for words, _ in sorted(KEYS, key=lambda k: -sum(map(len, k[0]))))
#: A key that no letter or digit comes before, its closing quote, and what parts it from the value.
_KEY = re.compile(rf"(?<![A-Za-z0-9])(?P<key>{_NAMES})(?![A-Za-z0-9_])(?P<quote>\\*[\"']?)(?P<gap>\s*[:=]\s*|\s+)", re.I)
_ANY = tuple(re.compile("[_-]?".join(words), re.I) for words, strong in KEYS if strong)
_VALUE, _QUOTE, _MARKS = re.compile(r"[A-Za-z0-9._@+-]+"), re.compile(r"\\*[\"']"), re.compile(r"[\"{}\[\]]")
_ID, _ID_SIGN = re.compile(r"[A-Za-z0-9._@+:/=-]{6,}"), re.compile(r"[0-9@]|(?<=.)[A-Z]|[A-Za-z0-9][._][A-Za-z0-9]", re.S)


def looks_like_id(value: str) -> bool:
    """Six characters or more of an id, with a digit, an at sign, a capital after the first letter or an inner dot or underscore."""
    return bool(_ID.fullmatch(value) and _ID_SIGN.search(value))


def _ends_string(text: str, at: int, depth: int) -> bool:
    """Whether the quote at ``at`` is one of a text that was escaped ``depth`` backslashes deep, not one inside it.

    At that depth a real quote has ``depth`` backslashes, and each backslash of the string itself has become 2 * depth + 2.
    """
    slashes = at - len(text[:at].rstrip("\\"))
    return slashes >= depth and (slashes - depth) % (2 * depth + 2) == 0


def _string_end(text: str, at: int, quote: str, depth: int) -> int:
    """Where the string that goes on at ``at`` has its closing quote; -1 if nowhere."""
    while (at := text.find(quote, at)) >= 0:
        if _ends_string(text, at, depth):
            return at
        at += 1
    return -1


def _block_end(text: str, at: int, depth: int) -> int:
    """The end of the list or object that begins at ``at``; -1 if it is not closed within reach."""
    open_, inside = 0, False
    for m in _MARKS.finditer(text, at, at + REACH):
        if m[0] == '"':
            inside ^= _ends_string(text, m.start(), depth)
        elif not inside:
            open_ += 1 if m[0] in "{[" else -1
            if not open_:
                return m.end()
    return -1


def _first(text: str, at: int, stops: str) -> int:
    return min((i for s in stops if (i := text.find(s, at)) >= 0), default=len(text))


def mask_values(text: str) -> str:
    """``text`` with the values of account keys masked: strings to their real end, lists and objects as a whole, plain words."""
    out, done, at = [], 0, 0
    while m := _KEY.search(text, at):
        start, quote, gap = m.end(), m["quote"], m["gap"]
        depth, stated = max(0, len(quote) - 1), ":" in gap or "=" in gap
        # "email: must be given" is prose; an address in it has a shape of its own.
        prose = not quote and m["key"][0] in "eE" and bool(re.match(r"\s*:\s", gap))
        strong = stated and not prose and any(k.fullmatch(m["key"]) for k in _ANY)
        opens, end, mask = _QUOTE.match(text, start, start + 16) if stated else None, -1, MASK
        if opens:
            inner = len(opens[0]) - 1
            close = _string_end(text, opens.end(), opens[0][-1], inner)
            value_end = close - inner if close >= 0 else _first(text, start, "\n")
            value = text[opens.end() : value_end]
            if value and not value.startswith("[redacted") and (strong or looks_like_id(value)):
                end, mask = (close + 1 if close >= 0 else value_end), opens[0] + MASK + opens[0]
        elif stated and text[start : start + 1] in ("{", "[") and not text.startswith("[redacted", start):
            end = _block_end(text, start, depth)
            end, mask = (end if end >= 0 else _first(text, start, ",}\n")), (quote or '"') + MASK + (quote or '"')
        elif (value := _VALUE.match(text, start)) and (strong or looks_like_id(value[0])):
            end, mask = value.end(), quote + MASK + quote
        if end < 0:
            at = m.end("key")
            continue
        out += [text[done:start], mask]
        done = at = end
    return "".join(out) + text[done:]


@F.pandas_udf(T.StringType())
def _masked(texts: pd.Series) -> pd.Series:
    return texts.map(mask_values, na_action="ignore")


def redact(text: Column, most: int | None = None) -> Column:
    """Values of account keys, credentials, addresses and home folders masked, then cut to ``most`` characters.

    The cut comes last: it can never halve a secret. Values of generic keys (user, account), and values parted from their
    key by a blank only, go if they look like an id. Only texts that hold a key leave the engine, in Arrow batches.
    """
    text = F.when(text.rlike(f"(?i)(?<![A-Za-z0-9])({_NAMES})(?![A-Za-z0-9_])"), _masked(text)).otherwise(text)
    for pattern, by in SECRETS:
        text = F.regexp_replace(text, pattern, by)
    return text if most is None else F.substring(text, 1, most)


#: What an absolute path becomes, and what a fragment of an address must not speak of.
ABSOLUTE_PATH = "<absolute path>"
_TELLTALE = "(?is)^#.*([=&]|token|secret|pass|key|auth).*$"


def redact_spec(spec: Column) -> Column:
    """A dependency specifier fit for a report: no absolute paths, user names, queries, telling fragments, tokens and controls.

    The user part of an address goes up to its last at sign, with a password that holds slashes too; ``git@`` says nothing and
    stays, and so do fragments that name a version or branch.
    """
    path = r"(?s)^((?:file|link|portal|path):)?(?:/|~[/\\]|[A-Za-z]:[\\/]).*$"
    local = F.regexp_replace(spec, path, f"$1{ABSOLUTE_PATH}")
    parts = r"(?s)^((?:[A-Za-z][A-Za-z0-9+.-]*:)?//)([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda k: F.regexp_extract(local, parts, k)
    place, query, fragment = part(2), part(3), part(4)
    host = F.regexp_extract(place, "^[^/]*", 0)
    # Without an at sign before the first slash, a colon that no port follows begins a password that holds a slash.
    hidden = F.when(F.contains(host, F.lit("@")), F.regexp_extract(host, "(?s)^(.*)@", 1)).when(host.rlike(":([^0-9]|$)"), F.regexp_extract(place, "(?s)^(.*)@", 1)).otherwise("")
    rest = F.substring(place, F.length(hidden) + 1, F.length(place))
    shown = F.when((hidden != "") & (hidden != "git"), F.concat(F.lit("[redacted]"), rest)).when(F.startswith(place, F.lit("@")), F.concat(F.lit("[redacted]"), place)).otherwise(place)
    address = F.concat(part(1), shown, F.when(query != "", "?[redacted]").otherwise(""), F.when(fragment.rlike(_TELLTALE), "#[redacted]").otherwise(fragment))
    out = mask_tokens(F.when(local.rlike(parts), address).otherwise(local))
    for pattern, by in SECRETS:
        if pattern.startswith(("glpat", "npm_")):
            out = F.regexp_replace(out, pattern, by)
    return plain_controls(out)

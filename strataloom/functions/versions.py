"""Versions and what they must meet, as column expressions.

A requirement is a list of terms; each term stands for a half-open interval of versions, and a version meets the
requirement if all intervals hold it. Versions are structs of three numbers, which Spark orders field by field.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The signs of a term, and which end of a version's own interval they take as (low, high): its start, its end, or no bound.
#: Caret, tilde, equals and no sign take an interval that depends on the numbers given.
SIGNS: dict[str, tuple[str | None, str | None] | None] = {
    "^": None, "~": None, "=": None, ">=": ("start", None), ">": ("end", None), "<": (None, "start"), "<=": (None, "end"),
}

_NUMBER, _TAGS = r"(\d+|\*)", "[0-9A-Za-z.-]+"
#: A term: a sign, one to three numbers or stars, and tags.
TERM = rf"^({'|'.join(map(re.escape, sorted(SIGNS, key=len, reverse=True)))})?\s*{_NUMBER}(?:\.{_NUMBER})?(?:\.{_NUMBER})?(?:[-+]{_TAGS})?$"
_VERSION = rf"\d+\.\d+\.\d+(?:-{_TAGS})?(?:\+{_TAGS})?"
#: An entry of a lock file: quotes and a slash around either a version with its peers after an underscore, or a version after the
#: name it stands for; peers in brackets may follow.
_ENTRY = rf"(?s)^['\"]?/?(?:({_VERSION})_[^(]*|(?:[^(]+@)?v?({_VERSION}))(?:\(.*)?['\"]?$"
_LINK = "^['\"]?(link|file|workspace|portal):"


def triple(a: Column, b: Column, c: Column) -> Column:
    return F.struct(a.alias("major"), b.alias("minor"), c.alias("patch"))


def version_triple(version: Column) -> Column:
    """The three leading numbers of a version; null for anything else."""
    part = lambda i: F.regexp_extract(version, r"^(\d+)\.(\d+)\.(\d+)", i).try_cast("long")
    return F.when(part(1).isNotNull() & part(2).isNotNull() & part(3).isNotNull(), triple(part(1), part(2), part(3)))


def _interval(term: Column) -> Column:
    """(low, high) of one term; a null high has no end."""
    zero = F.lit(0).cast("long")
    op = F.regexp_extract(term, TERM, 1)
    said = [F.regexp_extract(term, TERM, i) for i in (2, 3, 4)]
    value = [s.try_cast("long") for s in said]  # a star or nothing is null
    known = F.when(value[0].isNull(), 0).when(value[1].isNull(), 1).when(value[2].isNull(), 2).otherwise(3)
    a, b, c = (F.coalesce(v, zero) for v in value)
    low = triple(a, b, c)
    after = [None, triple(a + 1, zero, zero), triple(a, b + 1, zero), triple(a, b, c + 1)]
    # Caret: all may change right of the first number that is not zero, or of the last one given.
    lead = F.when((known >= 1) & (a > 0), 1).when((known >= 2) & (b > 0), 2).when((known >= 3) & (c > 0), 3).otherwise(known)
    star = (said[1] == "*") | (said[2] == "*")
    fixed = F.when(star | (op == "="), known).when(op == "~", F.least(known, F.lit(2))).when(op.isin("", "^"), lead)
    high = F.when(fixed == 1, after[1]).when(fixed == 2, after[2]).when(fixed == 3, after[3])
    least = F.when(fixed.isNotNull(), low)
    bound = {"start": low, "end": after[3]}
    for sign, sides in SIGNS.items():
        for side in sides or ():
            if side and side == sides[0]:
                least = least.when(op == sign, bound[side])
            elif side:
                high = high.when(op == sign, bound[side])
    least = least.otherwise(triple(zero, zero, zero))
    none = known == 0
    return F.struct(F.when(none, triple(zero, zero, zero)).otherwise(least).alias("low"), F.when(~none, high).alias("high"))


def requirement_matches(need: Column, have: Column) -> Column:
    """Whether a version meets a requirement of caret, tilde, wildcard and comparison terms, joined by commas.

    Null if either can't be read. A bare version is a caret term, empty terms say nothing, and prerelease tags are not
    compared.
    """
    terms = F.filter(F.transform(F.split(need, ","), lambda x: F.trim(x)), lambda x: x != "")
    own = version_triple(have)

    def meets(term: Column) -> Column:
        span = _interval(term)
        return (own >= span["low"]) & (span["high"].isNull() | (own < span["high"]))

    readable = F.forall(terms, lambda x: x.rlike(TERM)) & own.isNotNull()
    return F.when(readable, F.forall(terms, meets))


def lock_version(raw: Column) -> Column:
    """(kind, version) of a lock entry: a version, a local link, or another source.

    One pattern tells the parts of an entry: quotes, a slash, the name before an at sign, the version, and its peers.
    """
    entry = F.trim(raw)
    found = F.nullif(F.concat(F.regexp_extract(entry, _ENTRY, 1), F.regexp_extract(entry, _ENTRY, 2)), F.lit(""))
    local = entry.rlike(_LINK)
    kind = F.when(local, "local").when(found.isNotNull(), "version").when(raw.isNotNull(), "source")
    return F.struct(kind.alias("kind"), F.when(~local, found).alias("version"))

"""License scans: fuzzy search for short notices.

A notice that may be off by k edits is split into k + 1 pieces; by the pigeonhole principle every match holds one of them
unchanged. One Aho-Corasick pass finds the pieces, and the regex library's bounded-error matching verifies the places
around them, counts the edits and gives the span.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .common import text_slices


@dataclass(frozen=True)
class Notice:
    """A phrase of lower-case words that tells of a licence; ``edits``: how many characters may differ.

    In a phrase of fewer than BRIEF letters, the words of fewer than SHORT letters must stand unchanged: an edit there makes
    another phrase ("edit license", "exit license"). Elsewhere edits may fall on any character.
    """

    label: str
    phrase: str
    edits: int
    base: bool = False

    @property
    def fixed_words(self) -> list[str]:
        words = self.phrase.split()
        return [w for w in words if len(w) < SHORT] if sum(map(len, words)) < BRIEF else []


BRIEF, SHORT = 20, 5

#: The base phrases, then the notices that the method adds.
NOTICES = (
    Notice("mit", "mit license", 1, True),
    Notice("apache", "apache license", 1, True),
    Notice("gpl", "general public license", 2, True),
    Notice("mit", "permission is hereby granted free of charge to any person", 5),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("mpl", "mozilla public license", 2),
    Notice("epl", "eclipse public license", 2),
    Notice("bsl", "boost software license", 2),
    Notice("isc", "permission to use copy modify and or distribute this software", 5),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 6),
    Notice("cc", "creative commons attribution", 2),
    Notice("proprietary", "all rights reserved", 1),
)

#: Bytes of words stay, A-Z become lower case, all others part words.
_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


class NoticeSearch:
    """Finds exact and slightly altered notices in a text of any length."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.notices = notices
        seeds: dict[str, list[tuple[int, int]]] = {}
        self.patterns, self.fixed = [], []
        for k, n in enumerate(notices):
            parts, size = n.edits + 1, len(n.phrase)
            cuts = [size * j // parts for j in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(n.phrase[a:b], []).append((k, a))
            self.fixed.append(n.fixed_words)
            self.patterns.append(regex.compile(f"(?e)(?<![^ ])(?:{regex.escape(n.phrase, special_only=True)}){{e<={n.edits}}}(?![^ ])"))
        self.machine = ahocorasick.Automaton()
        for s, uses in seeds.items():
            self.machine.add_word(s, (len(s), uses))
        self.machine.make_automaton()

    def search(self, text: str) -> tuple[int, list[tuple[int, int, int, str, int]]]:
        """(number of words, places as (notice number, first word, words, text of the span, edits)).

        Places of one notice do not overlap; those without edits are complete. Of a notice off by at most its number of edits a
        place is found that it overlaps, whatever characters differ, but for the fixed words of brief notices (see Notice).
        """
        words = text.encode("utf-8", "replace").translate(_WORDS).split()
        flat = b" ".join(words).decode("latin-1")  # one character per byte
        n = len(flat)
        exact: dict[int, set[int]] = {}
        near: dict[int, list[tuple[int, int]]] = {}
        for end, (size, uses) in self.machine.iter(flat):
            for k, offset in uses:
                notice = self.notices[k]
                start = end + 1 - size - offset
                stop = start + len(notice.phrase)
                if start >= 0 and flat.startswith(notice.phrase, start):
                    if (start == 0 or flat[start - 1] == " ") and (stop == n or flat[stop] == " "):
                        exact.setdefault(k, set()).add(start)
                        continue
                # A non-ASCII character takes up to four bytes.
                slack = 4 * notice.edits + 1
                a, b = max(0, start - slack), min(n, stop + slack)
                spans = near.setdefault(k, [])
                if spans and spans[-1][0] <= a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
        found = [(k, s, s + len(self.notices[k].phrase), 0) for k, starts in exact.items() for s in starts]
        for k, spans in near.items():
            taken = sorted((s, s + len(self.notices[k].phrase)) for s in exact.get(k, ()))
            starts = [s for s, _ in taken]
            done = -1
            for a, b in sorted(spans):
                a = max(a, done)
                if a >= b:
                    continue
                a, b = flat.rfind(" ", 0, a) + 1, (n if (e := flat.find(" ", b)) < 0 else e)
                window = flat[a:b]
                plain = window.isascii()
                seen = window if plain else window.encode("latin-1").decode("utf-8", "replace")
                for m in self.patterns[k].finditer(seen, overlapped=True):
                    rest = iter(m[0].split())
                    if not (edits := sum(m.fuzzy_counts)) or not all(w in rest for w in self.fixed[k]):
                        continue
                    s = a + (m.start() if plain else len(seen[: m.start()].encode("utf-8")))
                    e = s + (m.end() - m.start() if plain else len(m[0].encode("utf-8")))
                    at = bisect_right(starts, e - 1) - 1
                    if at >= 0 and taken[at][1] > s or s < done:
                        continue  # it overlaps an exact place, or one that is found already
                    found.append((k, s, e, edits))
                    done = e
        found.sort(key=lambda x: (x[1], x[0]))
        out, count, last = [], 0, 0
        for k, s, e, edits in found:
            count += flat.count(" ", last, s)
            last = s
            span = flat[s:e].encode("latin-1").decode("utf-8", "replace")
            out.append((k, count, span.count(" ") + 1, span, edits))
        return len(words), out


@functools.cache
def _search(notices: tuple[Notice, ...]) -> NoticeSearch:
    return NoticeSearch(notices)


_SPAN = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("span", pa.string()), ("edits", pa.int64())])


def license_scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of words and exact base places, labels, a score and all spans with their edits.

    ``score`` is the best 1 - edits / length of a place, 0 without one. A null or empty text has no words, null
    positions, empty labels, score 0 and no spans. A text of any length is searched whole. Null ids stay null, repeated rows
    give repeated results, an empty table gives no rows; other columns are neither read nor returned, whatever their names.
    No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"{id_col} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
        " spans array<struct<label string, notice string, first_word long, words long, span string, edits long>>"
    )

    def run(batches):
        find = _search(notices)
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for text in (t for texts in text_slices(b.column(1)) for t in texts):
                n_words, places = find.search(text)
                base = [p for p in places if not p[4] and notices[p[0]].base]
                row = (
                    n_words,
                    len(base),
                    min((p[1] for p in base), default=None),
                    max((p[1] for p in base), default=None),
                    ",".join(sorted({notices[p[0]].label for p in base})),
                    ",".join(sorted({notices[p[0]].label for p in places})),
                    max((1 - p[4] / len(notices[p[0]].phrase) for p in places), default=0.0),
                    [dict(zip(("label", "notice", "first_word", "words", "span", "edits"), (notices[k].label, notices[k].phrase, *rest))) for k, *rest in places],
                )
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(_SPAN)]
            arrays = [b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return spread(docs.select(F.col(id_col), F.col(text_col).cast("string"))).mapInArrow(run, schema)

"""Fill-in-middle transformation by overlapping chunks.

A unit of text starts wherever a predicate holds of two adjacent bytes, so a text can be cut into chunks that overlap by
one byte and each chunk counts its boundaries on its own. The chunks of all texts of a batch are counted in parallel with
array operations; prefix sums of the counts tell which chunk owns each of the two cuts of a text, and only those chunks are
scanned again for the place itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")

#: Bytes of a chunk, and bytes of text that are worked on at once (a longer text is worked on alone).
CHUNK, SLAB = 1 << 14, 1 << 22

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

#: Whether a unit starts at a byte, from the byte before it and the byte itself; the first byte of a text always starts one.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "lines": lambda before, here: before == 10,
    "words": lambda before, here: _BLANK[before] & ~_BLANK[here],
    "characters": lambda before, here: (here & 0xC0) != 0x80,
}


class Chunks:
    """Boundary counts of the chunks of many texts that lie in one byte array, text i at ``ends[i] .. ends[i + 1]``."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, starts_unit: Callable, size: int = CHUNK):
        self.data, self.ends, self.starts_unit = data, ends.astype(np.int64), starts_unit
        lengths = np.diff(self.ends)
        per_text = -(-lengths // size)
        self.first = np.concatenate([[0], np.cumsum(per_text)])  # the first chunk of each text
        owner = np.repeat(np.arange(len(lengths)), per_text)
        self.at = self.ends[owner] + (np.arange(len(owner)) - self.first[owner]) * size
        self.to = np.minimum(self.at + size, self.ends[owner + 1])
        self.head = self.at == self.ends[owner]
        self.units, self.chars = np.zeros(len(self.at), np.int64), np.zeros(len(self.at), np.int64)
        # Texts lie end to end, so chunks in a row tile the array: some hundred of them are counted at once.
        for c in range(0, len(self.at), step := max(1, SLAB // size)):
            at, to, head = self.at[c : c + step], self.to[c : c + step], self.head[c : c + step]
            low, high = at[0], to[-1]
            marks = self._marks(low, high)
            marks[at[head] - low] = True
            self.units[c : c + step] = np.add.reduceat(marks.view(np.uint8), at - low, dtype=np.int64)
            self.chars[c : c + step] = np.add.reduceat(((self.data[low:high] & 0xC0) != 0x80).view(np.uint8), at - low, dtype=np.int64)
        self.units_to, self.chars_to = np.cumsum(self.units), np.cumsum(self.chars)
        self.units_at, self.chars_at = (np.concatenate([[0], x]) for x in (self.units_to, self.chars_to))

    def _marks(self, a: int, b: int) -> np.ndarray:
        """Where units start in bytes a to b, judged by pairs of bytes: a chunk reads one byte of the chunk before it."""
        before = np.empty(b - a, np.uint8)
        before[1:] = self.data[a : b - 1]
        before[0] = self.data[a - 1] if a else 0
        return self.starts_unit(before, self.data[a:b])

    def n_units(self) -> np.ndarray:
        return self.units_at[self.first[1:]] - self.units_at[self.first[:-1]]

    def cut(self, text: int, rank: int) -> tuple[int, int]:
        """(bytes, characters) of a text before its unit ``rank``, counted from 0; all of them for the number of units."""
        begin, end = self.first[text], self.first[text + 1]
        goal = self.units_at[begin] + rank
        if goal >= self.units_at[end]:
            return int(self.ends[text + 1] - self.ends[text]), int(self.chars_at[end] - self.chars_at[begin])
        own = int(np.searchsorted(self.units_to[begin:end], goal, side="right")) + begin
        marks = self._marks(self.at[own], self.to[own])
        if self.head[own]:
            marks[0] = True
        place = int(np.flatnonzero(marks)[goal - self.units_at[own]])
        inside = self.data[self.at[own] : self.at[own] + place]
        chars = self.chars_at[own] - self.chars_at[begin] + np.count_nonzero((inside & 0xC0) != 0x80)
        return int(self.at[own] + place - self.ends[text]), int(chars)


def _slabs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about SLAB bytes of text (column 1), of one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > SLAB:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if at < len(sizes):
        yield batch.slice(at)


def _transform(batch: pa.RecordBatch, starts_unit: Callable, sentinels: tuple[str, str, str], fim_percent: int, spm_percent: int) -> list[pa.Array]:
    """(n, form, prefix_chars, middle_chars, output) of a batch (id, text, h1, h2, h3, h4)."""
    texts = pc.fill_null(batch.column(1), "").cast(pa.string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    chunks = Chunks(data, ends, starts_unit)
    n = chunks.n_units()
    h1, h2, h3, h4 = (batch.column(2 + j).to_numpy() for j in range(4))
    low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
    plain = (n == 0) | (h3 % 100 >= fim_percent)
    for s in sentinels:
        plain |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    spm = h4 % 100 < spm_percent
    p, s, m = (x.encode() for x in sentinels)
    forms, prefixes, middles, outputs = [], [], [], []
    for i in range(len(texts)):
        whole = data[ends[i] : ends[i + 1]].tobytes()
        if plain[i]:
            row = "plain", None, None, whole
        else:
            (a, a_chars), (b, b_chars) = chunks.cut(i, int(low[i])), chunks.cut(i, int(high[i]))
            prefix, middle, suffix = whole[:a], whole[a:b], whole[b:]
            made = (s, suffix, p, prefix, m, middle) if spm[i] else (p, prefix, s, suffix, m, middle)
            row = "spm" if spm[i] else "psm", a_chars, b_chars - a_chars, b"".join(made)
        for column, value in zip((forms, prefixes, middles, outputs), row):
            column.append(value)
    return [pa.array(n, pa.int64()), pa.array(forms), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())]


def fill_in_middle(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, units: str = "lines", sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output) per row: each text cut at two units and put in another order.

    ``n`` counts the units; lines end after their line feed. The cuts and the form come from a hash of ``seed`` and the id
    alone. A null or empty text, or one that holds a sentinel, stays as it is: form plain, no counts, null becomes the empty
    text. A text of any length is cut whole, in chunks. Null ids hash as the empty string and stay null; repeated rows give
    repeated results, since ties of both cuts make an empty middle and nothing depends on order; an empty table gives no rows;
    other columns are neither read nor returned, whatever their names. No shuffle.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(key, 8 * j + 1, 8), 16, 10).cast("long").alias(f"__h{j}") for j in range(4)]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    starts_unit = UNITS[units]

    def run(batches):
        for b in batches:
            for part in _slabs(b):
                yield pa.RecordBatch.from_arrays([part.column(0), *_transform(part, starts_unit, sentinels, fim_percent, spm_percent)], names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    return spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"), *hashes)).mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from an output and its form, as a column expression. No part holds a sentinel, so each is found once."""
    p, s, m = map(_quoted, sentinels)
    return (
        F.when(form == "psm", F.regexp_replace(output, f"(?s)^{p}(.*){s}(.*){m}(.*)$", "$1$3$2"))
        .when(form == "spm", F.regexp_replace(output, f"(?s)^{s}(.*){p}(.*){m}(.*)$", "$2$3$1"))
        .otherwise(output)
    )


def _quoted(sentinel: str) -> str:
    return re.sub(r"([^\w\s<>])", r"\\\1", sentinel)


def fill_in_middle_digest(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """:func:`fill_in_middle` with hashes of the output and of the text rebuilt from it in place of the output; odd rows as there."""
    made = fill_in_middle(docs, id_col=id_col, **how)
    return made.select(
        id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


#: DuckDB SQL for the registered query.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
  ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(list_filter(l, lambda x, i: i <= a), '') AS pre, array_to_string(list_filter(l, lambda x, i: i > a AND i <= b), '') AS mid,
  array_to_string(list_filter(l, lambda x, i: i > b), '') AS suf,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""

"""Quality rules: counts per text, and a linear-chain conditional random field over its lines.

The field labels each line content or boilerplate from simple features and from the labels of its neighbours; Viterbi
decoding gives the best labelling, and the share of characters in content lines decides on the document. The weights are
fitted on a bounded sample of labelled documents, whose lines take their document's label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Bounds of the fitting sample: labelled documents, and lines of each.
FIT_DOCS, FIT_LINES = 1500, 64

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_DIGITS, _UPPER = b"0123456789", bytes(range(65, 91))
_LOWER_OR_WIDE = bytes([*range(97, 123), *range(128, 256)])
N_FEATURES = 12


def base_counts(text: str) -> tuple[int, int, int, int, int, bool]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes: parts at ASCII white space only
    n = len(words)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    n_symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(_SPACE):
            seen.add(line)
    repeat = 0
    if n >= 4:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
        size = len(numbers)
        if size < 2_000_000:
            key = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
        else:
            key = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)[1].ravel()
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = count[at] > 1
        if twice.any():
            cover = np.zeros(n, bool)
            for j in range(3):
                cover[j : n - 2 + j] |= twice
            repeat = int(cover.sum())
    return n, word_chars, n_symbols, dup, repeat, n < 50 or 100 * repeat > 50 * n


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, characters) of the lines that hold a word."""
    rows, sizes, seen = [], [], set()
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        if not words:
            continue
        size = sum(map(len, words))
        rest = lambda drop: size - len(dense.translate(None, drop))
        dense = b"".join(words)
        upper, lower = rest(_UPPER), rest(_LOWER_OR_WIDE)
        digits, symbols = rest(_DIGITS), rest(_SYMBOLS)
        k = len(words)
        rows.append(
            (
                1.0,
                min(np.log1p(k) / 4, 2.0),
                min(size / k / 8, 4.0),
                lower / size,
                upper / max(1, upper + lower),
                digits / size,
                min(4 * symbols / size, 2.0),
                min(4 * dense.count(b"!") / size, 2.0),
                1 - len(set(words)) / k,
                1.0 if words[-1][-1:] in (b".", b"?", b":") else 0.0,
                1.0 if line in seen else 0.0,
                1.0 if k <= 3 else 0.0,
            )
        )
        sizes.append(size)
        seen.add(line)
    return np.array(rows, np.float32).reshape(-1, N_FEATURES), np.array(sizes, np.int64)


@dataclass(frozen=True)
class LineField:
    """Weights of the field: label 1 is content. ``emit`` is (features, 2), ``move`` is (2, 2)."""

    emit: np.ndarray
    move: np.ndarray

    @classmethod
    def fit(cls, feats: list[np.ndarray], labels: list[int], steps: int = 120, rate: float = 0.2, ridge: float = 1e-3) -> LineField:
        """Maximum conditional likelihood by gradient steps with forward-backward over padded sequences."""
        n, longest = len(feats), max(map(len, feats))
        x = np.zeros((n, longest, N_FEATURES))
        mask = np.zeros((n, longest), bool)
        for i, f in enumerate(feats):
            x[i, : len(f)] = f
            mask[i, : len(f)] = True
        y = np.array(labels)
        gold = np.zeros((n, longest, 2))
        gold[np.arange(n), :, y] = 1
        gold *= mask[..., None]
        share = np.bincount(y, minlength=2).clip(1)
        weight = (n / 2 / share)[y]  # both classes count alike
        weight = weight / np.maximum(mask.sum(1), 1)
        emit, move = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
        m1, m2 = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
        pairs = mask[:, 1:] & mask[:, :-1]
        gold_move = np.zeros((n, 2, 2))
        gold_move[np.arange(n), y, y] = pairs.sum(1)
        for t in range(1, steps + 1):
            s = x @ emit
            fwd, bwd = np.zeros_like(s), np.zeros_like(s)
            fwd[:, 0] = s[:, 0]
            for k in range(1, longest):
                step = np.logaddexp(fwd[:, k - 1, 0, None] + move[0], fwd[:, k - 1, 1, None] + move[1]) + s[:, k]
                fwd[:, k] = np.where(mask[:, k, None], step, fwd[:, k - 1])
            for k in range(longest - 2, -1, -1):
                step = bwd[:, k + 1] + s[:, k + 1]
                step = np.logaddexp(move[:, 0] + step[:, :1], move[:, 1] + step[:, 1:])
                bwd[:, k] = np.where(mask[:, k + 1, None], step, 0)
            z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
            p = np.exp(np.minimum(fwd + bwd - z[:, None, None], 0)) * mask[..., None]
            joint = fwd[:, :-1, :, None] + move + (s + bwd)[:, 1:, None, :] - z[:, None, None, None]
            joint = (np.exp(np.minimum(joint, 0)) * pairs[..., None, None]).sum(1)
            grads = [
                np.einsum("nlf,nlc,n->fc", x, gold - p, weight) / n - ridge * emit,
                np.einsum("nab,n->ab", gold_move - joint, weight) / n - ridge * move,
            ]
            for w, g, a, b in zip((emit, move), grads, m1, m2):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w += rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
        return cls(emit, move)

    def decode(self, feats: np.ndarray) -> list[int]:
        """Viterbi: the most likely labels of the lines."""
        scores = (feats @ self.emit).tolist()
        if not scores:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = scores[0]
        back = []
        for e0, e1 in scores[1:]:
            to0, to1 = (a + m00 >= b + m10), (a + m01 > b + m11)
            back.append((0 if to0 else 1, 0 if to1 else 1))
            a, b = (a + m00 if to0 else b + m10) + e0, (a + m01 if to1 else b + m11) + e1
        out = [1 if b >= a else 0]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def content_share(self, text: str) -> float:
        """Share of the word characters that lie in content lines; 0 for a text without words."""
        feats, sizes = line_features(text)
        if not len(sizes):
            return 0.0
        return float((sizes * np.array(self.decode(feats))).sum() / sizes.sum())


def fit_line_field(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_lines: int = FIT_LINES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineField | None:
    """Fit on at most ``fit_docs`` labelled documents, dealt by a hash of their ids, and ``fit_lines`` lines of each.

    Rows with a null or other label count for nothing, nor do documents without a labelled id; of an id with several labels
    the least counts. Long texts give their first ``fit_lines`` lines with words. None where not both labels are at hand.
    """
    chosen = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc")).agg(F.min(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc"), "doc").limit(fit_docs)
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("body"))

    def features(batches):
        for b in batches:
            made = [line_features(t.as_py() or "")[0][:fit_lines].tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(made, pa.binary())], names=["doc", "label", "f"])

    # The sample has fit_docs ids at most: that bounds the broadcast. Rows that repeat an id count as one text, that with the
    # least hash, so no more rows than ids reach the driver.
    texts = source.join(F.broadcast(chosen), "doc").groupBy("doc").agg(F.min(F.struct(F.xxhash64("body").alias("h"), "body", "label")).alias("x"))
    rows = texts.select("doc", "x.body", "x.label").mapInArrow(features, "doc long, label int, f binary").limit(fit_docs).collect()
    rows = sorted((r.doc, r.label, bytes(r.f)) for r in rows if len(r.f))
    if len({r[1] for r in rows}) < 2:
        return None
    return LineField.fit([np.frombuffer(r[2], np.float32).reshape(-1, N_FEATURES) for r in rows], [r[1] for r in rows])


def quality_rules(docs: DataFrame, labels: DataFrame, min_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept) per row.

    ``kept`` needs the base rules passed and a content share of ``min_share``. Null and empty texts have zero counts and
    fail. A text of any length is counted whole. Without labels of both kinds there is no field, and the base rules decide
    alone (content_share is null). Null ids stay null, repeated rows give repeated results, an empty table gives no rows;
    other columns are neither read nor returned, whatever their names. No shuffle of texts.
    """
    field = fit_line_field(docs, labels, id_col=id_col, text_col=text_col)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {', '.join(f'{c} long' for c in longs)}, base_failed boolean, content_share double, kept boolean"

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for v in b.column(1):
                text = v.as_py() or ""
                counts = base_counts(text)
                share = field.content_share(text) if field else None
                for c, x in zip(cols, (*counts, share, not counts[5] and (share is None or share >= min_share))):
                    c.append(x)
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=[id_col, *longs, "base_failed", "content_share", "kept"])

    return spread(docs.select(F.col(id_col), F.col(text_col).cast("string"))).mapInArrow(run, schema)


def quality_filter(docs: DataFrame, field: LineField | None, min_share: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns; what counts as passing is as in quality_rules."""

    def run(batches):
        for b in batches:
            at = b.schema.names.index(text_col)
            keep = []
            for i, v in enumerate(b.column(at)):
                text = v.as_py() or ""
                if not base_counts(text)[5] and (field is None or field.content_share(text) >= min_share):
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    return docs.mapInArrow(run, docs.schema)

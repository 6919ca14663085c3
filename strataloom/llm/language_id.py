"""Language identification of words, spans and documents.

Learned from labelled texts: hashed counts of the letter n-grams of each language's words, and the scripts it is written in.
A word's script narrows the languages that it may belong to; each of those gets a log-likelihood, and Viterbi decoding with a
penalty for switching labels the words of a text, so that texts in several languages fall into spans. The language with the
most letters is the document's.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .common import text_slices

#: First and last code points of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x139F)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}

#: Sizes of n-grams, cells that all languages' tables have together at most, and cells of one language at most.
ORDERS, CELLS, BUCKETS = (1, 2, 3, 4), 1 << 24, 1 << 16

#: Words longer than this are cut, so that scripts without blanks have places to switch at.
LONGEST = 24

#: Score of a language that a word's script rules out.
_NEVER = -1e9

_WORD = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)

_RANGES = sorted((a, b, k) for k, spans in enumerate(SCRIPTS.values(), 1) for a, b in spans)
_FIRST, _LAST, _SCRIPT = (np.array(x) for x in zip(*_RANGES))


def script_of(letters: np.ndarray) -> np.ndarray:
    """Number of the script of each code point, from 1 in the order of SCRIPTS; 0 for none of them."""
    at = np.maximum(np.searchsorted(_FIRST, letters, side="right") - 1, 0)
    return np.where((letters >= _FIRST[at]) & (letters <= _LAST[at]), _SCRIPT[at], 0)


def word_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cells, word starts, letters, script) of words: row n of ``cells`` has a cell for each place, ``buckets`` for none.

    The last row has the cell of the whole word at the word's first place.
    """
    marked = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    codes = marked.astype(np.uint64)
    cells = np.full((len(ORDERS) + 1, len(codes)), buckets, np.int64)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    for row, n in enumerate(ORDERS):
        if len(codes) < n:
            continue
        m = len(codes) - n + 1
        mixed = np.full(m, n, np.uint64)
        for j in range(n):
            mixed = (mixed ^ codes[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        inside = word[:m] == word[n - 1 :]
        if n == 1:
            inside &= codes > 3
        cells[row, :m] = np.where(inside, (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> shift, np.uint64(buckets)).astype(np.int64)
    cells[-1, starts] = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) % buckets
    return cells, starts, sizes - 2, script_of(marked[starts + 1])


@dataclass(frozen=True)
class LanguageModel:
    """``weights``: (cells + 1, languages) log probabilities, 0 in the last cell. ``may``: (scripts + 1, languages)."""

    languages: tuple[str, ...]
    weights: np.ndarray
    may: np.ndarray
    penalty: float = 6.0
    worst: float = -12.0

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores by language, letters, whether the script is one of a learned language's) of words."""
        parts, letters, known = [], [], []
        for at in range(0, len(words), 4096):
            cells, starts, sizes, script = word_features(words[at : at + 4096], len(self.weights) - 1)
            total = sum(np.add.reduceat(self.weights[row], starts) for row in cells) / len(ORDERS)
            may = self.may[script]
            some = may.any(1)
            best = np.where(may, total, -np.inf).max(1, initial=-np.inf)
            total = np.where(may, np.maximum(total - best[:, None], self.worst), _NEVER)
            parts.append(np.where(some[:, None], total, 0.0))
            letters.append(sizes)
            known.append(some)
        return np.concatenate(parts), np.concatenate(letters), np.concatenate(known)


def fit_language_model(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = 6.0, least_share: float = 0.005) -> LanguageModel | None:
    """Counts over all rows that ``train`` selects and that have a text and a language; None where there are none.

    Words are counted in the engine, distinct words are cut into n-grams after that. The model has ``CELLS`` numbers at most,
    whatever the input: with many languages each gets fewer cells; more than CELLS / 1024 languages are refused.
    A script counts for a language from a share of ``least_share`` of its letters on.
    """
    own = docs.where(train).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.lower(F.col(text_col).cast("string")).alias("body"))
    n_languages = own.agg(F.count_distinct("lang").alias("n")).first().n
    if not n_languages:
        return None
    buckets = BUCKETS
    while buckets * n_languages > CELLS:
        buckets //= 2
    if buckets < 1024:
        raise ValueError(f"{n_languages} languages are more than a model can hold")
    words = own.select("lang", F.explode(F.split("body", r"[^\p{L}]+")).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    scripts = len(SCRIPTS) + 1

    def count(batches):
        tables: dict[str, np.ndarray] = {}
        for b in batches:
            langs, found, n = (c.to_pylist() for c in b.columns)
            for lang in set(langs):
                table = tables.setdefault(lang, np.zeros(buckets + 1 + scripts))
                mine = [i for i, x in enumerate(langs) if x == lang]
                pieces = [(p, n[i]) for i in mine for p in _WORD.findall(found[i])]
                for at in range(0, len(pieces), 4096):
                    part = pieces[at : at + 4096]
                    cells, starts, sizes, script = word_features([p for p, _ in part], buckets)
                    times = np.array([k for _, k in part], np.float64)
                    spread_times = np.repeat(times, sizes + 2)
                    for row in cells:
                        table[: buckets + 1] += np.bincount(row, spread_times, buckets + 1)
                    table[buckets + 1 :] += np.bincount(script, times * sizes, scripts)
        for lang, table in tables.items():
            table[buckets] = 0
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(table[at])], names=["lang", "cell", "n"])

    sums = words.mapInArrow(count, "lang string, cell int, n double").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows and a few
    languages = tuple(sorted(set(sums.column("lang").to_pylist())))
    if not languages:
        return None
    place = {x: i for i, x in enumerate(languages)}
    table = np.zeros((buckets + 1 + scripts, len(languages)))
    table[sums.column("cell").to_numpy(), [place[x] for x in sums.column("lang").to_pylist()]] = sums.column("n").to_numpy()
    grams, letters = table[:buckets], table[buckets + 1 :]
    weights = np.zeros((buckets + 1, len(languages)), np.float32)
    weights[:buckets] = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * buckets))
    return LanguageModel(languages, weights, letters >= least_share * np.maximum(letters.sum(0), 1), penalty)


def best_labels(words: np.ndarray, ends: np.ndarray, scores: np.ndarray, penalty: float, longest: int = 2048) -> np.ndarray:
    """Viterbi labels of the words of many texts, text i at ``ends[i] .. ends[i + 1]``; row w of ``scores`` is of word w.

    All texts advance together, word by word. Texts of more than ``longest`` words are cut into stretches that are decoded once
    for each label that the word before may have, and the best way through the stretches is found after that.
    """
    n = scores.shape[1]
    row_at, row_to, entry, chains = [], [], [], []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        chain = []
        for at in range(a, b, longest):
            labels = [-1] if at == a else np.flatnonzero(scores[words[at - 1]] > _NEVER / 2).tolist()
            chain.append((len(row_at), labels))
            row_at += [at] * len(labels)
            row_to += [min(at + longest, b)] * len(labels)
            entry += labels
        if chain:
            chains.append(chain)
    out = np.zeros(len(words), np.int32)
    if not chains:
        return out
    at, sizes, entry = np.array(row_at), np.array(row_to) - np.array(row_at), np.array(entry)
    order = np.argsort(-sizes, kind="stable")
    at, sizes, entry = at[order], sizes[order], entry[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    flat = np.cumsum(sizes) - sizes
    value = np.where((entry[:, None] < 0) | (entry[:, None] == np.arange(n)), 0.0, _NEVER)
    best = np.zeros(int(sizes.sum()), np.int32)
    stays = np.zeros((len(best), n), bool)
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # rows that have a word t
    for t, k in enumerate(active.tolist()):
        v = value[:k]
        top = v.argmax(1)
        other = v[np.arange(k), top] - penalty
        stay = v >= other[:, None]
        spot = flat[:k] + t
        best[spot], stays[spot] = top, stay
        value[:k] = np.where(stay, v, other[:, None]) + scores[words[at[:k] + t]]
    chosen, exits = [], []
    for chain in chains:
        v, steps = value[place[chain[0][0]]], []
        for first, labels in chain[1:]:
            ways = v[labels][:, None] + value[place[first : first + len(labels)]]
            took = ways.argmax(0)
            steps.append(took)
            v = ways[took, np.arange(n)]
        label = int(v.argmax())
        for (first, labels), took in zip(chain[:0:-1], steps[::-1]):
            chosen.append(place[first + took[label]])
            exits.append(label)
            label = labels[took[label]]
        chosen.append(place[chain[0][0]])
        exits.append(label)
    chosen, state = np.array(chosen), np.array(exits)
    order = np.argsort(-sizes[chosen], kind="stable")
    chosen, state = chosen[order], state[order]
    at, sizes, flat = at[chosen], sizes[chosen], flat[chosen]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    for u, k in enumerate(active.tolist()):
        t = sizes[:k] - 1 - u
        s = state[:k]
        out[at[:k] + t] = s
        spot = flat[:k] + t
        state[:k] = np.where(stays[spot, s], s, best[spot])
    return out


class LanguageSpans:
    """Labels texts with a model; scores of words are kept from text to text."""

    def __init__(self, model: LanguageModel, keep: int = 300_000):
        self.model, self.keep = model, keep
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))
        self.letters, self.known = np.zeros(0, np.int64), np.zeros(0, bool)

    def label(self, texts: list[str]) -> tuple[list[str], list[float], list[list[tuple[str, int, int, int]]]]:
        """(language, share of its letters, spans as (language, first word, words, letters)) of each text."""
        if len(self.number) > self.keep:
            self._forget()
        number, done = self.number, len(self.number)
        found, ends = [], [0]
        for t in texts:
            # A number or the like that counts as alphanumeric is no letter.
            found += [number.setdefault(w, len(number)) for w in _WORD.findall(t.lower()) if w.isalpha() or any(map(str.isalpha, w))]
            ends.append(len(found))
        if len(number) > done:
            made = self.model.score(list(number)[done:])
            self.scores, self.letters, self.known = (np.concatenate(x) for x in zip((self.scores, self.letters, self.known), made))
        words, ends = np.array(found, np.int64), np.array(ends)
        labels = best_labels(words, ends, self.scores, self.model.penalty)
        n = len(self.model.languages)
        text = np.repeat(np.arange(len(texts)), np.diff(ends))
        letters = self.letters[words]
        sums = np.bincount(text * n + labels, letters * self.known[words], len(texts) * n).reshape(-1, n)
        total = np.bincount(text, letters, len(texts))
        top = sums.argmax(1)
        share = sums[np.arange(len(texts)), top] / np.maximum(total, 1)
        begins = np.flatnonzero(np.diff(text, prepend=-1).astype(bool) | np.diff(labels, prepend=-1).astype(bool))
        span_letters = np.add.reduceat(letters, begins) if len(begins) else letters
        span_words = np.diff(np.append(begins, len(words)))
        spans: list[list] = [[] for _ in texts]
        for i, s, k, c in zip(text[begins].tolist(), begins.tolist(), span_words.tolist(), span_letters.tolist()):
            spans[i].append((self.model.languages[labels[s]], s - int(ends[i]), k, c))
        return [self.model.languages[k] if m else "und" for k, m in zip(top.tolist(), total.tolist())], share.tolist(), spans


_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("letters", pa.int64())]))


def language_spans(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "spans")) -> DataFrame:
    """(id_col, lang_pred, score, spans) per row: the language with the most letters, their share, and the spans of languages.

    Only the text is looked at. A null or empty text, or one without a letter, is "und" with score 0 and no spans; so is every
    text without a model. Words of scripts that no learned language has go with their neighbours and count for no language;
    a text of such words alone gets the first language, with score 0. Ties go to the language that sorts first. A text of
    any length is labelled whole. Null ids stay null, repeated rows give repeated results, an empty table gives no rows; other
    columns are neither read nor returned, whatever their names. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    columns = [id_col, *names]
    schema = f"`{id_col}` {kind}, {names[0]} string, {names[1]} double, {names[2]} array<struct<lang string, first_word long, words long, letters long>>"
    held = docs.sparkSession.sparkContext.broadcast(model)  # CELLS numbers at most

    def run(batches):
        spans = LanguageSpans(held.value) if held.value else None
        for b in batches:
            at = 0
            for texts in text_slices(b.column(1)):
                made = spans.label(texts) if spans else (["und"] * len(texts), [0.0] * len(texts), [[]] * len(texts))
                out = [[dict(zip(("lang", "first_word", "words", "letters"), s)) for s in own] for own in made[2]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(made[0], pa.string()), pa.array(made[1], pa.float64()), pa.array(out, _SPANS)], names=columns)
                at += len(texts)

    return spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether the CRC-32 of an id as text leaves ``part`` of ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score, spans): every text labelled by a model of the rows that are not held out; odd rows as in :func:`language_spans`."""
    model = fit_language_model(docs, ~held_out(id_col), id_col, text_col, lang_col)
    return language_spans(docs, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "spans")

"""Token counts: rank-synchronous merging over ragged arrays.

The distinct pre-tokens of a batch lie in one flat symbol array. Each round finds the lowest-rank adjacent pair of every
sequence and merges all its occurrences at once; what survives when no pair has a rank is the token count.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .common import text_slices, vocab_path
from .vocab import Vocab, load_vocab

_NONE = np.int32(2**31 - 1)


class RaggedMerger:
    """Counts the symbols that are left of byte sequences after all merges of a vocabulary."""

    def __init__(self, vocab: Vocab):
        self.vocab = vocab
        m = np.array(vocab.merges, np.int64).reshape(-1, 3)
        keys = m[:, 0] * vocab.size + m[:, 1]
        order = np.argsort(keys)
        self.keys, self.key_rank, self.merged = keys[order], order.astype(np.int32), m[:, 2].astype(np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys) or not len(left):
            return np.full(len(left), _NONE, np.int32)
        key = left.astype(np.int64) * self.vocab.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], _NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each sequence."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        out = lens.copy()
        who = np.flatnonzero(lens > 1)
        if not len(who):
            return out
        flat = np.frombuffer(b"".join(words[i] for i in who), np.uint8)
        lens = lens[who]
        ends = np.cumsum(lens)
        sym = self.vocab.byte_sym[flat]
        sym[ends - 1] = self.vocab.byte_end[flat[ends - 1]]
        rank = np.full(len(sym), _NONE, np.int32)  # of the pair that starts at each symbol
        rank[:-1] = self._rank(sym[:-1], sym[1:])
        rank[ends - 1] = _NONE
        while len(who):
            starts = ends - lens
            low = np.minimum.reduceat(rank, starts)
            live = low != _NONE
            if not live.all():
                out[who[~live]] = lens[~live]
                keep = np.repeat(live, lens)
                sym, rank, who, lens, low = sym[keep], rank[keep], who[live], lens[live], low[live]
                if not len(who):
                    break
                ends = np.cumsum(lens)
            hit = rank == np.repeat(low, lens)
            at = np.flatnonzero(hit)
            if len(at) > 1:  # x x x: in a run of touching pairs, every second one from the left
                first = np.r_[True, np.diff(at) > 1]
                run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            gone = at + 1
            seq_last = np.zeros(len(sym), bool)
            seq_last[ends - 1] = True
            last_of = seq_last[gone]
            keep = np.ones(len(sym), bool)
            keep[gone] = False
            lens = lens - np.add.reduceat(~keep, ends - lens)
            seq_last[at] |= last_of
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            sym, rank, touched, seq_last = sym[keep], rank[keep], touched[keep], seq_last[keep]
            ends = np.cumsum(lens)
            again = touched.copy()
            again[:-1] |= touched[1:]
            again = np.flatnonzero(again & ~seq_last)
            rank[np.flatnonzero(touched & seq_last)] = _NONE
            rank[again] = self._rank(sym[again], sym[again + 1])
        return out


class TokenCounter:
    """Token counts of texts; distinct pre-tokens are merged once and kept in a bounded cache."""

    def __init__(self, path: str, cache_words: int = 1_200_000, cache_len: int = 48):
        self.vocab = load_vocab(path)
        self.merger = RaggedMerger(self.vocab)
        self.cache: dict[str, int] = {}
        self.cache_words, self.cache_len = cache_words, cache_len

    def count(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        cut, missing, out = [], set(), []
        cache = self.cache
        for text in texts:
            mine = []
            for words, special in self.vocab.pieces(text) if text else ():
                missing |= set(words).difference(cache)
                mine.append((words, special is not None))
            cut.append(mine)
        if missing and len(cache) + len(missing) > self.cache_words:
            cache.clear()
            missing = {w for mine in cut for words, _ in mine for w in words}
        new = list(missing)
        cache.update(zip(new, self.merger.counts([w.encode() for w in new]).tolist()))
        for mine in cut:
            out.append(sum(sum(map(cache.__getitem__, words)) + special for words, special in mine))
        for w in new:
            if len(w) > self.cache_len:
                del cache[w]
        return out


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def _sentencepiece_counts(path: str, texts: list[str]) -> list[int]:
    return [len(x) for x in _sentencepiece(path).encode(texts, num_threads=1)]


@functools.lru_cache(maxsize=2)
def _sentencepiece(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for every row; no shuffle.

    ``path``: a tokenizers .json file (merged here) or a sentencepiece .model file. A null text counts as the empty text
    (0 bytes, 0 tokens), a null id stays null, repeated rows give repeated results, an empty table gives no rows, and
    other columns of ``docs`` are neither read nor returned, whatever their names. A text of any length is counted whole,
    in blocks that end between words.
    """
    path = path or vocab_path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType
    schema = f"{id_col} {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches):
        for b in batches:
            sizes, tokens = [], []
            for texts in text_slices(b.column(1)):
                sizes += [len(t) if t.isascii() else len(t.encode()) for t in texts]
                tokens += _sentencepiece_counts(path, texts) if path.endswith(".model") else _counter(path).count(texts)
            n = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), n, pa.array([t > limit for t in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return spread(docs.select(F.col(id_col), F.col(text_col).cast("string"))).mapInArrow(run, schema)

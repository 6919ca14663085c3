"""BPE encoding and decoding as streams with bounded memory.

Encoding is a left-to-right transducer. From the merge list a sufficient lookahead is computed: how many symbols after a
token's end can still decide about that token. What lies further from the end of the buffer is stable and is emitted; the
buffer never holds more than the lookahead and one block. (Berglund and van der Merwe, "Formalizing BPE Tokenization".)
Decoding feeds the bytes of each token to an incremental byte-to-text state machine.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .common import text_slices, vocab_path
from .vocab import Vocab, byte_chars, load_vocab


def sufficient_lookahead(merges: list[tuple[int, int, int]]) -> int:
    """Symbols after a token's end that suffice to know that the token stands.

    A merge r = (x, y) that starts with a token x on the right edge of a longer token, and ranks before the merge that
    uses x there, takes x away; whether r happens depends on what lies within y and, in turn, on merges of lower rank
    that take the right edge of y away. ``reach[r]`` adds these lengths up, in order of rank.
    """
    length: dict[int, int] = {}
    parent: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left, right)
    starts: dict[int, tuple[list[int], list[int]]] = {}  # left token -> ranks, running maximum of the reach

    def size(t: int) -> int:
        return length.get(t, 1)

    def beyond(token: int, rank: int) -> int:
        """Reach beyond the right edge of a token that is used at ``rank``."""
        most = 0
        while True:
            ranks, best = starts.get(token, ((), ()))
            at = bisect_left(ranks, rank)
            if at:
                most = max(most, best[at - 1])
            if token not in parent:
                return most
            rank, _, token = parent[token]

    for r, (x, y, z) in enumerate(merges):
        length[z], parent[z] = size(x) + size(y), (r, x, y)
        reach = size(y) + beyond(y, r)
        ranks, best = starts.setdefault(x, ([], []))
        ranks.append(r)
        best.append(max(reach, best[-1] if best else 0))
    tokens = {t for m in merges for t in m}
    return max((beyond(t, len(merges)) for t in tokens), default=0)


class StreamEncoder:
    """Encodes text piece by piece; holds at most ``lookahead + block`` symbols of a pre-token."""

    def __init__(self, vocab: Vocab, block: int = 512, cache_words: int = 700_000, cache_len: int = 32):
        self.vocab = vocab
        self.ranks = {(a, b): (r, c) for r, (a, b, c) in enumerate(vocab.merges)}
        self.lookahead = sufficient_lookahead(vocab.merges)
        self.width = {}
        for a, b, c in vocab.merges:
            self.width[c] = self.width.get(a, 1) + self.width.get(b, 1)
        self.block = max([block, *self.width.values()])  # a block holds any token, so every round emits
        self.byte_sym, self.byte_end = vocab.byte_sym.tolist(), vocab.byte_end.tolist()
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cache_words, self.cache_len = cache_words, cache_len

    def merge(self, sym: list[int]) -> list[int]:
        """All merges of a bounded buffer: lowest rank first, leftmost first."""
        ranks = self.ranks
        if len(sym) <= 24:
            while len(sym) > 1:
                best = min((ranks[p] for p in zip(sym, sym[1:]) if p in ranks), default=None)
                if best is None:
                    break
                out, k, n, rank = [], 0, len(sym), best[0]
                while k < n:
                    if k + 1 < n and ranks.get((sym[k], sym[k + 1]), (-1,))[0] == rank:
                        out.append(best[1])
                        k += 2
                    else:
                        out.append(sym[k])
                        k += 1
                sym = out
            return sym
        n = len(sym)
        sym, after, before, dead = list(sym), list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [(ranks[p][0], k, p) for k, p in enumerate(zip(sym, sym[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            j = after[k]
            if dead[k] or j >= n or (sym[k], sym[j]) != pair:
                continue
            sym[k] = ranks[pair][1]
            dead[j] = 1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (p := (sym[a], sym[b])) in ranks:
                    heapq.heappush(heap, (ranks[p][0], a, p))
        return [s for s, d in zip(sym, dead) if not d]

    def word(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of one pre-token, given as a stream of symbols, each emitted once it is stable."""
        source, held = iter(symbols), []
        while True:
            held += islice(source, self.lookahead + self.block - len(held))
            tokens = self.merge(held)
            if len(held) < self.lookahead + self.block:
                yield from tokens
                return
            at = 0
            for t in tokens:
                w = self.width.get(t, 1)
                if at + w > self.block:
                    break
                yield t
                at += w
            held = held[at:]

    def _symbols(self, word: str) -> Iterator[int]:
        raw = word.encode()
        for b in raw[:-1]:
            yield self.byte_sym[b]
        yield self.byte_end[raw[-1]]

    def stream(self, text: str) -> Iterator[list[int]]:
        """Lists of ids, one for each bounded block of the text; together they are its encoding."""
        cache = self.cache
        for words, special in self.vocab.pieces(text):
            new = {w for w in set(words).difference(cache) if len(w) <= self.cache_len}
            if len(cache) + len(new) > self.cache_words:
                cache.clear()
                new = {w for w in words if len(w) <= self.cache_len}
            for w in new:
                cache[w] = tuple(self.word(self._symbols(w)))
            out: list[int] = []
            for w in words:
                if (ids := cache.get(w)) is not None:
                    out += ids
                    continue
                for t in self.word(self._symbols(w)):
                    out.append(t)
                    if len(out) >= 1 << 16:
                        yield out
                        out = []
            if special is not None:
                out.append(special)
            if out:
                yield out


class StreamDecoder:
    """Turns ids into text piece by piece.

    A byte-level file decodes the tokens' bytes, with U+FFFD for what is no UTF-8; a file without a decoder gives its
    tokens' strings parted by one blank, as the library does.
    """

    def __init__(self, vocab: Vocab):
        self.joined = not vocab.decodes_bytes
        if self.joined:
            self.bytes = [s.encode() for s in vocab.strings]
        else:
            back = {c: b for b, c in enumerate(byte_chars())}
            special = set(vocab.special.values())
            self.bytes = [s.encode() if i in special else bytes(back[c] for c in s) for i, s in enumerate(vocab.strings)]

    def stream(self, blocks: Iterable[list[int]]) -> Iterator[str]:
        """Pieces of text as soon as their bytes make whole characters."""
        state, first = codecs.getincrementaldecoder("utf-8")("replace"), True
        for ids in blocks:
            raw = (b" " if self.joined else b"").join(map(self.bytes.__getitem__, ids))
            if self.joined and not first:
                raw = b" " + raw
            first = False
            yield state.decode(raw)
        if rest := state.decode(b"", True):
            yield rest


@functools.lru_cache(maxsize=2)
def _codec(path: str) -> tuple[StreamEncoder, StreamDecoder, list[bytes]]:
    vocab = load_vocab(path)
    return StreamEncoder(vocab), StreamDecoder(vocab), [str(i).encode() for i in range(vocab.size)]


def encode_digest(path: str, text: str) -> tuple[int, str, str]:
    """(tokens, SHA-256 of the decimal ids, SHA-256 of the decoded text), all in one pass over the stream."""
    encoder, decoder, decimal = _codec(path)
    ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0

    def watch() -> Iterator[list[int]]:
        nonlocal n
        for ids in encoder.stream(text):
            ids_hash.update((b" " if n else b"") + b" ".join(map(decimal.__getitem__, ids)))
            n += len(ids)
            yield ids

    for piece in decoder.stream(watch()):
        text_hash.update(piece.encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def bpe_round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) per row; no shuffle.

    Null and empty texts have no tokens and the hashes of the empty string. Null ids stay null, repeated rows give
    repeated results, an empty table gives no rows; other columns are neither read nor returned, whatever their names. A text
    of any length streams through in constant memory beside the text itself.
    """
    path = path or vocab_path("word_bpe_49k.json")
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        for b in batches:
            rows = [encode_digest(path, t) for texts in text_slices(b.column(1)) for t in texts]
            n, ids, text = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return spread(docs.select(F.col(id_col), F.col(text_col).cast("string"))).mapInArrow(run, schema)


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) per row; nulls and clashes as in :func:`bpe_round_trip`."""
    path = path or vocab_path("word_bpe_49k.json")
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>"

    def run(batches):
        encoder = _codec(path)[0]
        for b in batches:
            ids = [[i for part in encoder.stream(t) for i in part] for texts in text_slices(b.column(1)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return spread(docs.select(F.col(id_col), F.col(text_col).cast("string"))).mapInArrow(run, schema)


def bpe_decode(ids: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """(id_col, text_col) per row of token ids; a null list gives the empty text."""
    path = path or vocab_path("word_bpe_49k.json")
    schema = f"{id_col} {ids.schema[id_col].dataType.simpleString()}, {text_col} string"

    def run(batches):
        decoder = _codec(path)[1]
        for b in batches:
            texts = ["".join(decoder.stream([v.as_py() or []])) if v.is_valid and len(v) else "" for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, text_col])

    return ids.select(F.col(id_col), F.col(ids_col).cast("array<int>")).mapInArrow(run, schema)

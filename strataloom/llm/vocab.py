"""Vocabulary files of BPE tokenizers: normalising, cutting into pre-tokens, merges, and word-cached library encoding.

The cutting follows the file's own definition. The library's Unicode tables are newer than Python's, so a text with
code points that Python does not know is cut by the library itself.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

from .common import blocks

#: The pre-token patterns in the two public vocabulary files, and Unicode White_Space.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _ranges(codes) -> str:
    out, start, last = [], None, None
    for c in codes:
        if last is not None and c == last + 1:
            last = c
            continue
        if start is not None:
            out.append((start, last))
        start = last = c
    if start is not None:
        out.append((start, last))
    esc = lambda c: f"\\U{c:08x}"
    return "".join(esc(a) if a == b else f"{esc(a)}-{esc(b)}" for a, b in out)


#: Alphabets by their end: Latin, the basic plane, all of Unicode. The smaller the classes, the faster the matching.
_TIERS = (0x250, 0x10000, sys.maxunicode + 1)
_BEYOND = [re.compile(f"[^\\U00000000-\\U{t - 1:08x}]") for t in _TIERS[:2]]


@functools.cache
def _patterns(tier: int) -> dict[str, re.Pattern]:
    """Pre-token patterns for texts whose characters all lie below a tier's end; "unknown" finds unassigned ones."""
    cat = [unicodedata.category(chr(c)) for c in range(_TIERS[tier])]
    letters = _ranges(c for c, k in enumerate(cat) if k[0] == "L")
    numbers = _ranges(c for c, k in enumerate(cat) if k[0] == "N")
    unknown = _ranges(c for c, k in enumerate(cat) if k == "Cn")
    space = _ranges(c for c in _SPACES if c < _TIERS[tier])
    # No letter or number begins with a quote, so the letters may be tried first.
    return {
        "word": re.compile(f"[{letters}]+|[{numbers}]|{_CONTRACTIONS}|[^{space}{letters}{numbers}]+"),
        "byte": re.compile(
            f" ?[{letters}]+|{_CONTRACTIONS}| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+"
            f"|[{space}]+(?![^{space}])|[{space}]+"
        ),
    } | ({"unknown": re.compile(f"[{unknown}]")} if unknown else {})


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Vocab:
    """One vocabulary file. ``kind`` is "word" (lower case, word ends) or "byte" (byte level)."""

    def __init__(self, path: str):
        # One thread: the cores belong to Spark's tasks.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.kind = "word" if self.suffix else "byte"
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.decodes_bytes = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        self.strings = [""] * self.size
        for s, i in [*self.ids.items(), *self.special.items()]:
            self.strings[i] = s
        #: (left id, right id, merged id) by rank.
        self.merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in model["merges"]]
        chars = byte_chars()
        self.byte_sym = np.array([self.ids[c] for c in chars], np.int32)
        self.byte_end = np.array([self.ids[c + self.suffix] for c in chars], np.int32)
        self._special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._check_merges()

    def _check_merges(self) -> None:
        """Every merge must come after those that build its parts: then equal ranks may be applied at once."""
        made = {}
        for r, (a, b, c) in enumerate(self.merges):
            if any(x in made and made[x] >= r for x in (a, b)) or c in made:
                raise ValueError("merge list is not ordered by construction")
            made[c] = r
        if any(made.get(x, -1) > r for r, (a, b, _) in enumerate(self.merges) for x in (a, b)):
            raise ValueError("merge list is not ordered by construction")

    def _cut(self, text: str) -> list[str]:
        tier = 0
        if not text.isascii():
            while tier < 2 and _BEYOND[tier].search(text):
                tier += 1
            known = _patterns(tier)
            if "unknown" in known and known["unknown"].search(text):
                if self.kind == "word":
                    text = self.library.normalizer.normalize_str(text)
                    return [s for s, _ in self.library.pre_tokenizer[0].pre_tokenize_str(text)]
                return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
            if self.kind == "word":
                text = unicodedata.normalize("NFC", text)
                if "Σ" in text:  # lower case letter by letter, without the final-sigma rule
                    text = text.replace("Σ", "σ")
        if self.kind == "word":
            text = text.lower()
            if tier == 0 and not text.isascii() and _BEYOND[0].search(text):
                tier = 1
        return _patterns(tier)[self.kind].findall(text)

    def pieces(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """(pre-tokens, id of the special token that follows them or None), block by block."""
        for block in blocks(text):
            if self._special_re is None or "<" not in block and self._plain_special():
                yield self._cut(block), None
                continue
            parts = self._special_re.split(block)
            for k in range(0, len(parts), 2):
                words = self._cut(parts[k]) if parts[k] else []
                yield words, self.special[parts[k + 1]] if k + 1 < len(parts) else None

    def _plain_special(self) -> bool:
        return all(s[0] == "<" for s in self.special)


@functools.lru_cache(maxsize=4)
def load_vocab(path: str) -> Vocab:
    """The vocabulary at a path, loaded once in each process."""
    return Vocab(path)


class LibraryEncoder:
    """Ids by the tokenizers library, asked once for each distinct pre-token of a bounded cache."""

    def __init__(self, path: str, cache_words: int = 900_000, cache_len: int = 48):
        self.vocab = load_vocab(path)
        self.cache: dict[str, bytes] = {}
        self.cache_words, self.cache_len = cache_words, cache_len

    def _ask(self, words: list[str]) -> None:
        # Read as written text: a pre-token is never a special token here.
        for w, e in zip(words, self.vocab.library.encode_batch_fast(words, add_special_tokens=False)):
            self.cache[w] = np.array(e.ids, np.uint32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text as uint32."""
        if not text:
            return np.zeros(0, np.uint32)
        out: list[bytes] = []
        cache = self.cache
        for words, special in self.vocab.pieces(text):
            missing = list(set(words).difference(cache))
            if missing:
                if len(cache) + len(missing) > self.cache_words:
                    cache.clear()
                    missing = list(set(words))
                self._ask(missing)
            out.append(b"".join(map(cache.__getitem__, words)))
            if missing:
                for w in missing:
                    if len(w) > self.cache_len:
                        del cache[w]
            if special is not None:
                out.append(np.uint32(special).tobytes())
        return np.frombuffer(b"".join(out), np.uint32)


@functools.lru_cache(maxsize=4)
def library_encoder(path: str) -> LibraryEncoder:
    """The word-cached encoder for a path, one in each process."""
    return LibraryEncoder(path)

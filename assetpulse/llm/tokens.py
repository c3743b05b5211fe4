"""Token ids of texts by a public tokenizer file, with a cache of pre-tokens.

Both vocabularies split a text by a pattern before any merge, so the ids of a
text are the ids of its pre-tokens in a row. Pre-tokens repeat, so each distinct
one goes through the tokenizers library once and its ids are then looked up. New
pre-tokens are encoded many at a time, as one text; where the words end is read
from the ids (an end-of-word mark, or the length in bytes).
Texts with characters whose class or case might be read differently by the two
pattern engines (capitals whose small letter lies beyond the plain range among
them), or that hold the string of a special token, are encoded whole by the
library instead.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np

#: The vocabularies' split patterns; {L} letters, {N} digits.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"[{L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{N}]|[^\s{L}{N}]+"

_PLAIN_END = 0x250
#: Distinct pre-tokens in each of the cache's two generations (a worker holds about 200 bytes for each).
CACHE_ENTRIES = 600_000
#: New pre-tokens that are encoded as one text; characters of texts whose new ones are gathered.
JOINED, TOGETHER = 2_000, 1 << 19


def _chars(kind: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(_PLAIN_END) if unicodedata.category(chr(i))[0] == kind)


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes; one per worker process and vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.lower = self.library.normalizer is not None
        pattern = WORD_PATTERN if self.lower else BYTE_PATTERN
        self.split = re.compile(pattern.replace("{L}", _chars("L")).replace("{N}", _chars("N"))).findall
        # Plain: what both engines class alike. Not so some separators, a dotted capital that
        # lower-cases to two characters and, where texts are lower-cased, capitals whose small
        # letter is outside the range.
        self.plain = frozenset(c for c in map(chr, range(_PLAIN_END)) if c not in "\x1c\x1d\x1e\x1fİ"
                               and not (self.lower and max(c.lower()) >= chr(_PLAIN_END)))
        #: Encodes runs of pre-tokens: those of the word vocabulary are small letters between spaces already.
        self.runs = self.library
        if self.lower:
            self.runs = Tokenizer.from_file(path)
            self.runs.normalizer = None
            self.runs.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.odd_latin = [c for c in map(chr, range(256)) if c not in self.plain]
        model = json.loads(self.library.to_str())["model"]
        mark = model.get("end_of_word_suffix")
        size = 1 + max(model["vocab"].values())
        #: Of each id: its bytes, or whether it ends a word.
        self.measure = np.zeros(size, np.int64)
        for piece, i in model["vocab"].items():
            self.measure[i] = (piece.endswith(mark) if mark else len(piece))
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def odd(self, text: str) -> bool:
        """Whether the library must encode the text whole: a character that is not plain, or the start of a special token."""
        if "<|" in text:
            return True
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return not self.plain.issuperset(set(text))
        return any(c in text for c in self.odd_latin)  # no set of its characters is needed

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text; texts of about ``TOGETHER`` characters share the look for new pre-tokens."""
        run, size = [], 0
        for text in texts:
            text = text if isinstance(text, str) else ""
            run.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._run(run)
                run, size = [], 0
        yield from self._run(run)

    def _run(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_ENTRIES:
            self.older, self.cache = self.cache, {}
        words = [None if self.odd(t) else self.split(t.lower() if self.lower else t) for t in texts]
        cache = self.cache
        self._add(self._unknown(set().union(*(w for w in words if w)).difference(cache)))
        # Every word is in the cache now, so one walk over a text gives its ids.
        return [self.whole(t) if w is None else b"".join(itemgetter(*w)(cache)) if len(w) > 1 else b"".join(map(cache.__getitem__, w))
                for t, w in zip(texts, words, strict=True)]

    def _unknown(self, words: set[str]) -> list[str]:
        """Those that the older generation of the cache lacks too; what it holds comes to the newer."""
        cache, older, new = self.cache, self.older, []
        for w in words:
            if (ids := older.get(w)) is None:
                new.append(w)
            else:
                cache[w] = ids
        return new

    def _add(self, new: list[str]) -> None:
        """Ids of new pre-tokens, those that can stand side by side together."""
        alone = new
        if self.lower:
            alone = self._joined(new, " ", lambda run, ids: np.flatnonzero(self.measure[ids]) + 1)
        elif new:
            def ends(run: list[str], ids: np.ndarray) -> np.ndarray:
                wanted = np.cumsum([len(w.encode()) for w in run])
                at = np.cumsum(self.measure[ids])
                place = np.searchsorted(at, wanted)
                return place + 1 if len(at) and (at[np.minimum(place, len(at) - 1)] == wanted).all() else place[:0]

            word = [w for w in new if w[0] == " " and w[1:].isalpha()]
            alone = [w for w in new if w[0] != " " or not w[1:].isalpha()] + self._joined(word, "", ends)
        for w, e in zip(alone, self.library.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            self.cache[w] = np.asarray(e.ids, "<u4").tobytes()

    def _joined(self, words: list[str], between: str, ends) -> list[str]:
        """Encode runs of words as one text each; returns the words of runs whose ids could not be told apart."""
        left = []
        for i in range(0, len(words), JOINED):
            run = words[i : i + JOINED]
            ids = np.asarray(self.runs.encode_batch_fast([between.join(run)], add_special_tokens=False)[0].ids, "<u4")
            end = ends(run, ids)
            if len(end) != len(run) or end[-1] != len(ids):
                left += run
                continue
            raw, at = ids.tobytes(), 0
            for w, e in zip(run, (4 * end).tolist(), strict=True):
                self.cache[w] = raw[at:e]
                at = e
        return left


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary(name: str) -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)

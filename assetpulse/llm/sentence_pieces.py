"""SentencePiece encoding and decoding with the place of every piece in the original text.

1. A text is normalised by longest prefixes: at each place the longest key of the
   model's compiled character map (a double-array trie) is replaced, and a
   character without a key stands for itself. Each normalised byte keeps the
   offset of the original bytes that it came from.
2. The normalised text is cut before every run of word marks. No piece of the
   vocabulary crosses such a cut (this is checked when the model is read), so
   merges never do either and each distinct segment needs to be merged once.
3. A piece covers a run of normalised bytes; the offsets of its ends project it to
   a span of the original UTF-8 bytes. Spans lie in order, without gaps between
   one and the next. Of the byte pieces of one character the last has its span.

The merges of new segments and the decoding are the sentencepiece library's.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_MARK = MARK.encode()
#: Segments up to so many characters are kept, so many in each of the cache's two generations.
CACHE_CHARS, CACHE_ENTRIES = 48, 300_000
#: Texts of so many bytes are encoded before their rows are handed on.
HAND_ON = 4 << 20


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        kind = tag & 7
        size = {1: 8, 5: 4}.get(kind) or (number() if kind == 2 else 0)
        if kind == 0:
            yield tag >> 3, number()
        else:
            yield tag >> 3, raw[at : at + size]
            at += size


class CharacterMap:
    """The compiled character map: its longest key at a place of a text, with the replacement."""

    def __init__(self, compiled: bytes):
        (size,) = struct.unpack_from("<I", compiled) if compiled else (0,)
        self.units = struct.unpack_from(f"<{size // 4}I", compiled, 4) if size else ()
        self.replacements = compiled[4 + size :]
        first = bytes(c for c in range(256) if self.units and self._step(self._base(0), c) is not None)
        self.starts = re.compile(b"[" + re.escape(first) + b"]").search if first else None

    # Fixed layout of a unit: bits 0-7 and 31 label, bit 8 "a key ends here", bit 9 wide offset, bits 10-30 offset.
    def _base(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << (8 if unit & 512 else 0))

    def _step(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """End of the longest key that begins at ``at``, and its replacement."""
        base, found = self._base(0), None
        for i in range(at, len(raw)):
            if (node := self._step(base, raw[i])) is None:
                break
            base = self._base(node)
            if self.units[node] & 256:
                found = i + 1, self.units[base] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.replacements[found[1] : self.replacements.index(b"\0", found[1])]


class Normaliser:
    """Normalised bytes of a text and, for each of them and the end, the offset that it came from."""

    def __init__(self, spec: bytes, suffix: bool = False):
        got = dict(_fields(spec))
        self.map = CharacterMap(bytes(got.get(2, b"")))
        self.dummy, self.squeeze, self.escape = (bool(got.get(k, 1)) for k in (3, 4, 5))
        self.suffix = suffix
        self.space = _MARK if self.escape else b" "

    def _mapped(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The text after replacements, spaces as they are, and the source offset of each byte."""
        out, origin, at = [], [], 0

        def plain(end: int) -> None:
            part = np.frombuffer(raw, np.uint8, end - at, at)
            offset = np.arange(at, end)
            offset[(part & 0xC0) == 0x80] = 0  # the bytes of a character come from its first
            out.append(raw[at:end])
            origin.append(np.maximum.accumulate(offset))

        while self.map.starts and (hit := self.map.starts(raw, at)):
            found = self.map.longest(raw, hit.start())
            if found is None:  # one character that is no key
                end = hit.start() + 1
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end += 1
            else:
                end = hit.start()
            if end > at:
                plain(end)
            if found is not None:
                out.append(found[1])
                origin.append(np.full(len(found[1]), end, np.int64))
                end = found[0]
            at = end
        if at < len(raw):
            plain(len(raw))
        return b"".join(out), np.concatenate(origin) if origin else np.empty(0, np.int64)

    def __call__(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        text, origin = self._mapped(raw)
        begin, end = 0, len(raw)
        if self.squeeze and text:
            buf = np.frombuffer(text, np.uint8)
            space = buf == 32
            kept = np.flatnonzero(~(space & np.concatenate(([True], space[:-1]))))  # neither leading nor after another space
            begin = int(origin[kept[0]]) if len(kept) else end
            text, origin = buf[kept].tobytes(), origin[kept]
        if not text:
            return b"", np.array([end], np.int64)
        if self.escape:
            wide = np.where(np.frombuffer(text, np.uint8) == 32, len(_MARK), 1)
            text, origin = text.replace(b" ", _MARK), np.repeat(origin, wide)
        if self.dummy and not self.suffix:
            text, origin = self.space + text, np.concatenate((np.full(len(self.space), begin, np.int64), origin))
        size = len(text)
        while self.squeeze and text.endswith(self.space, 0, size):  # a mark that stood in the text goes too
            size -= len(self.space)
        if size < len(text):
            end = int(origin[size])
            text, origin = text[:size], origin[:size]
        if self.dummy and self.suffix:
            text, origin = text + self.space, np.concatenate((origin, np.full(len(self.space), end, np.int64)))
        return text, np.append(origin, end)


def _message(number: int, body: bytes) -> bytes:
    return bytes([number << 3 | 2, len(body)]) + body


class PieceModel:
    """One per worker process and model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = self.library.serialized_model_proto()
        parts: dict[int, list] = {}
        for number, value in _fields(raw):
            parts.setdefault(number, []).append(value)
        trainer = dict(_fields(parts[2][0]))
        pieces = [dict(_fields(p)) for p in parts[1]]
        words, kinds = [bytes(p[1]) for p in pieces], [p.get(3, 1) for p in pieces]
        if trainer.get(3) != 2 or not trainer.get(35):  # fixed values: BPE, byte fallback
            raise ValueError("spans need a BPE model with byte fallback")
        self.normalise = Normaliser(bytes(parts[3][0]), bool(trainer.get(24)))
        # Piece kind 6 is a byte, kind 4 is matched before all merges.
        self.bytes_of = np.array([1 if k == 6 else len(w) for w, k in zip(words, kinds, strict=True)], np.int64)
        crossing = re.compile(b"(?!" + _MARK + b")[^\x80-\xbf][\x80-\xbf]*" + _MARK).search
        cut = self.normalise.escape and 4 not in kinds and not any(k == 1 and crossing(w) for w, k in zip(words, kinds, strict=True))
        self.segments = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if cut else "(?s:.+)").findall
        # The same pieces without normalisation: what it is given is merged as it stands.
        self.merges = sentencepiece.SentencePieceProcessor(
            model_proto=raw + _message(3, _message(1, b"identity") + b"\x12\x00\x18\x00\x20\x00\x28\x00"))
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _merged(self, segments: list[str]) -> bytes:
        distinct = set(segments)
        if len(self.cache) + len(distinct) > CACHE_ENTRIES:
            self.older, self.cache = self.cache, {}
        cache, older, long = self.cache, self.older, {}
        new = []
        for s in distinct:
            if s not in cache:
                if (ids := older.get(s)) is None:
                    new.append(s)
                else:
                    cache[s] = ids
        for s, ids in zip(new, self.merges.encode(new, num_threads=1), strict=True):
            (cache if len(s) <= CACHE_CHARS else long)[s] = np.asarray(ids, "<u4").tobytes()
        if long:
            return b"".join([long[s] if len(s) > CACHE_CHARS else cache[s] for s in segments])
        return b"".join([cache[s] for s in segments])

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids without begin and end, and the original byte offsets where pieces begin, with the end of the last."""
        normal, origin = self.normalise((text or "").encode("utf-8", "surrogatepass"))
        ids = np.frombuffer(self._merged(self.segments(normal.decode("utf-8", "surrogatepass"))), "<u4")
        edge = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.bytes_of[ids], out=edge[1:])
        if edge[-1] != len(normal):
            raise ValueError("the pieces do not cover the normalised text")
        return ids, origin[edge]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _rows(docs: DataFrame, model: str, row, columns: list[str], schema: str) -> DataFrame:
    """One row of ``columns`` for each document, by ``row(model, doc_id, text)``, handed on in bounded frames."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = piece_model(model)
        frame = lambda x: pd.DataFrame(x, columns=columns).astype({"doc_id": "Int64"})
        for part in parts:
            rows, size = [], 0
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                rows.append((None if pd.isna(doc_id) else doc_id, *row(loaded, text)))
                size += len(text or "")
                if size > HAND_ON:
                    yield frame(rows)
                    rows, size = [], 0
            yield frame(rows)

    return _texts(docs).mapInPandas(run, schema)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, ids, starts, ends)`` of ``docs(doc_id, text)``: the pieces and their spans in the text's UTF-8 bytes.

    ``ids`` has no begin and end id. A null text is empty and has no pieces. Rows
    are encoded one by one: repeated rows and null doc_ids come back as they are.
    Other columns are not read. An empty table gives no rows.
    """
    def row(loaded: PieceModel, text: str | None) -> tuple:
        ids, at = loaded.encode(text)
        return ids.astype(np.int32), at[:-1], at[1:]

    return _rows(docs, model, row, ["doc_id", "ids", "starts", "ends"], "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``(doc_id, text)`` of ``encoded(doc_id, ids)``; null or no ids decode to the empty text."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = piece_model(model)
        for part in parts:
            texts = [loaded.decode(np.asarray(ids if ids is not None else [], np.int64)) for ids in part["ids"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "text": texts})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInPandas(
        run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of each row, with begin and end ids.

    ``ids_sha256`` is of the ids as little-endian unsigned 32-bit integers,
    ``decoded_sha256`` of the text decoded from them. Nulls, repeats and empty
    tables as in ``encode``.
    """
    def row(loaded: PieceModel, text: str | None) -> tuple:
        ids = np.concatenate(([loaded.begin], loaded.encode(text)[0], [loaded.end])).astype("<u4")
        decoded = loaded.decode(ids).encode("utf-8", "surrogatepass")
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _rows(docs, model, row, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                 "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

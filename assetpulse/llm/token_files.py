"""Token-id files compressed by Re-Pair grammars, one grammar for each shard.

A shard repeatedly replaces frequent pairs of neighbouring ids by nonterminals;
a round replaces all pairs that are frequent at once, each from the left and
without overlap. A file holds the rules, the expansion length of every
nonterminal, the remaining symbols and where each document's symbols and ids
begin, so a document is decoded from its own symbols alone. Pairs never cross
a document's end.

File layout, little-endian: ``RPID``, version, then for each array its name,
type, length and bytes (see ``_pack``). Symbols are stored as 16-bit low halves
and as bit planes for what the largest symbol needs beyond 16 bits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetpulse.llm.shared import materialise, scratch
from assetpulse.llm.tokens import encoder
from assetpulse.llm.warc import _filesystem

MAGIC = b"RPID0001"
#: A shard ends after the document that takes it beyond so many ids.
SHARD_IDS = 1 << 20
ROUNDS = 6
#: A pair must occur so often in its shard; a nonterminal expands to at most MAX_LENGTH ids.
LEAST = 32
RULES_PER_ROUND = 4096
MAX_LENGTH = 64


def _counted(key: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in ascending order, each place's number among them, and their counts.

    Equal keys share a slot (below 2**20), and few slots hold several keys: the last key of each
    slot is counted by the slot, and only the places of other keys are sorted.
    """
    last = np.empty(1 << 20, np.uint64)
    last[slot] = key
    other = np.flatnonzero(last[slot] != key)
    count = np.bincount(slot, minlength=1 << 20)
    rest, rest_inverse, rest_count = np.unique(key[other], return_inverse=True, return_counts=True)
    np.subtract.at(count, slot[other], 1)
    used = np.flatnonzero(count)
    pair, number = np.concatenate((last[used], rest)), np.concatenate((count[used], rest_count))
    order = np.argsort(pair)
    rank = np.empty(len(pair), np.int64)
    rank[order] = np.arange(len(pair))
    of_slot = np.empty(1 << 20, np.int64)
    of_slot[used] = rank[: len(used)]
    inverse = of_slot[slot]
    inverse[other] = rank[len(used) + rest_inverse]
    return pair[order], inverse, number[order]


def _frequent(a: np.ndarray, b: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs (left, right) among the allowed places, the places that show one, and which one each shows."""
    slot = ((a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(12)).astype(np.int64)  # 2**20 counters
    slot[~allowed] = 1 << 20
    heavy = np.bincount(slot, minlength=(1 << 20) + 1) >= LEAST
    heavy[-1] = False
    at = np.flatnonzero(heavy[slot])
    if not len(at):
        return np.empty(0, np.uint32), np.empty(0, np.uint32), at, at
    pair, inverse, count = _counted((a[at].astype(np.uint64) << np.uint64(32)) | b[at], slot[at])
    best = np.argsort(-count, kind="stable")[:RULES_PER_ROUND]
    best = best[count[best] >= LEAST]
    rank = np.full(len(pair), -1, np.int64)
    rank[best] = np.arange(len(best))
    number = rank[inverse]
    shown = number >= 0
    chosen = pair[best]
    return (chosen >> np.uint64(32)).astype(np.uint32), (chosen & np.uint64(0xFFFFFFFF)).astype(np.uint32), at[shown], number[shown]


def compress(ids: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Grammar of ``ids`` (documents begin at ``starts``): first nonterminal, rules, lengths, symbols, places."""
    seq, first = ids.astype(np.uint32), int(ids.max()) + 1 if len(ids) else 0
    begins = np.zeros(len(ids), bool)
    begins[starts] = True
    left, right, lengths = [], [], []
    size = np.ones(first, np.uint16)
    for _ in range(ROUNDS):
        if len(seq) < 2:
            break
        total = size[seq]
        allowed = ~begins[1:] & (total[:-1] + total[1:] <= MAX_LENGTH)
        x, y, at, number = _frequent(seq[:-1], seq[1:], allowed)
        if not len(x):
            break
        # Neighbouring candidate places overlap: every second one of a run, from the left.
        run_start = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, at, 0))
        taken = (at - run_start) & 1 == 0
        at, number = at[taken], number[taken]
        base = len(size)
        left.append(x)
        right.append(y)
        grown = (size[x] + size[y]).astype(np.uint16)
        lengths.append(grown)
        size = np.concatenate((size, grown))
        seq[at] = (base + number).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, begins = seq[keep], begins[keep]
    cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
    return {"first": np.array([first], np.uint32), "left": cat(left, np.uint32), "right": cat(right, np.uint32),
            "expansion": cat(lengths, np.uint16), "symbols": seq, "places": np.flatnonzero(begins).astype(np.uint32)}


def expansions(g: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all nonterminals and where each begins."""
    first, left, right, size = int(g["first"][0]), g["left"], g["right"], g["expansion"].astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))
    flat = np.zeros(int(begin[-1]), np.uint32)
    # A rule refers to terminals and earlier rules only; all rules of one total length can be filled at once.
    for n in np.unique(size):
        rules = np.flatnonzero(size == n)
        into = begin[rules]
        for part, shift in ((left[rules], 0), (right[rules], None)):
            own = np.where(part >= first, size[np.maximum(part.astype(np.int64) - first, 0)] if len(size) else 1, 1)
            to = into if shift == 0 else begin[rules] + n - own
            plain = part < first
            flat[to[plain]] = part[plain]
            rest = np.flatnonzero(~plain)
            if len(rest):
                src, cnt = begin[part[rest].astype(np.int64) - first], own[rest]
                step = np.arange(int(cnt.sum())) - np.repeat(np.cumsum(cnt) - cnt, cnt)
                flat[np.repeat(to[rest], cnt) + step] = flat[np.repeat(src, cnt) + step]
    return flat, begin


def decode(g: dict[str, np.ndarray], symbols: np.ndarray, table: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The ids of a run of symbols."""
    flat, begin = table or expansions(g)
    first = int(g["first"][0])
    # One table for all symbols: an id stands for itself, a nonterminal for a stretch of ``flat``.
    stretch = np.concatenate((np.arange(first, dtype=np.uint32), flat))
    place = np.concatenate((np.arange(first), first + begin[:-1]))
    count = np.concatenate((np.ones(first, np.int64), np.diff(begin)))[symbols]
    ends = np.cumsum(count)
    return stretch[np.repeat(place[symbols] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    arrays = dict(arrays)
    symbols = arrays.pop("symbols")
    arrays["low"] = symbols.astype("<u2")
    for bit in range(16, int(symbols.max()).bit_length() if len(symbols) else 0):
        arrays[f"plane{bit}"] = np.packbits((symbols >> np.uint32(bit)) & np.uint32(1) == 1)
    out = [MAGIC, struct.pack("<I", len(arrays))]
    for name, x in arrays.items():
        kind = x.dtype.newbyteorder("<").str.encode()
        body = np.ascontiguousarray(x, x.dtype.newbyteorder("<")).tobytes()
        out.append(struct.pack("<B", len(name)) + name.encode() + struct.pack("<B", len(kind)) + kind + struct.pack("<Q", len(body)) + body)
    return b"".join(out)


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    (count,), at, got = struct.unpack_from("<I", raw, 8), 12, {}
    for _ in range(count):
        name = raw[at + 1 : at + 1 + raw[at]].decode()
        at += 1 + raw[at]
        kind = raw[at + 1 : at + 1 + raw[at]].decode()
        at += 1 + raw[at]
        (size,) = struct.unpack_from("<Q", raw, at)
        got[name] = np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 8)
        at += 8 + size
    symbols = got.pop("low").astype(np.uint32)
    for name in [k for k in got if k.startswith("plane")]:
        symbols |= np.unpackbits(got.pop(name), count=len(symbols)).astype(np.uint32) << np.uint32(name[5:])
    return got | {"symbols": symbols}


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str) -> DataFrame:
    """Write the ids of ``docs(doc_id, text)`` in ascending doc_id order; return ``(file, start, n_docs, n_tokens, bytes)``.

    A document is the ids of its text (null: empty) and ``end_id``. Null doc_ids
    come first; rows of one doc_id lie in the order of their texts. ``start`` is the
    number of ids in all files before. Other columns are not written. A shard
    holds ``SHARD_IDS`` ids and at most one more document.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    order = [F.col("doc_id").asc_nulls_first(), tie]
    dealt = read.repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode_all = encoder(vocabulary).encode_all
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        task, shard, end = TaskContext.get().partitionId(), 0, int(end_id).to_bytes(4, "little")

        def close(ids: list[bytes], names: list) -> pd.DataFrame:
            path = f"{root}/ids-{task:06d}-{shard:05d}.rpid"
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            starts = np.cumsum(sizes) - sizes
            made = compress(np.frombuffer(b"".join(ids), "<u4"), starts)
            known = np.array([not pd.isna(x) for x in names])
            made |= {"known": known, "doc_id": np.array([0 if pd.isna(x) else int(x) for x in names], np.int64),
                     "tokens": sizes.astype(np.uint32)}
            raw = _pack(made)
            with system.open_output_stream(f"{path}.tmp", compression=None) as f:
                f.write(raw)
            system.move(f"{path}.tmp", path)
            return pd.DataFrame({"file": [path], "task": [task], "shard": [shard], "n_docs": [len(ids)],
                                 "n_tokens": [int(sizes.sum())], "bytes": [len(raw)]})

        ids, names, size = [], [], 0
        for part in parts:
            for doc_id, raw in zip(part["doc_id"], encode_all(part["text"]), strict=True):
                raw += end
                ids.append(raw)
                names.append(doc_id)
                size += len(raw) // 4
                if size >= SHARD_IDS:
                    yield close(ids, names)
                    shard, ids, names, size = shard + 1, [], [], 0
        if ids:
            yield close(ids, names)

    files = materialise(dealt.mapInPandas(write, "file string, task int, shard int, n_docs long, n_tokens long, bytes long"), "files")
    before = Window.orderBy("task", "shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each million ids
    return files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("start"),
                        "n_docs", "n_tokens", "bytes")


def read_token_files(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every document, decoded from the files."""
    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _filesystem(folder)
        for part in parts:
            for path, start in zip(part["file"], part["start"], strict=True):
                with system.open_input_stream(path, compression=None) as f:
                    g = _unpack(f.read())
                table = expansions(g)
                ids = decode(g, g["symbols"], table)
                raw, tokens = ids.astype("<u4").tobytes(), g["tokens"].astype(np.int64)
                ends = np.cumsum(tokens)
                docs = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), tokens.tolist(), strict=True)]
                out = pd.DataFrame({"doc_id": pd.array(g["doc_id"], "Int64"), "start": start + ends - tokens, "n_tokens": tokens,
                                    "ids_crc32": [zlib.crc32(x) for x in docs]})
                out.loc[~g["known"], "doc_id"] = pd.NA
                if with_ids:
                    out["ids"] = docs
                yield out

    return files.select("file", "start").repartition(max(1, files.count())).mapInPandas(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def read_document(system, path: str, at: int) -> np.ndarray:
    """Random access: the ids of the document at position ``at`` of one file, from its own symbols alone."""
    with system.open_input_stream(path, compression=None) as f:
        g = _unpack(f.read())
    ends = np.append(g["places"], len(g["symbols"]))
    return decode(g, g["symbols"][ends[at] : ends[at + 1]])


def token_file_round_trip(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    folder = scratch(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, vocabulary, end_id, folder), folder)

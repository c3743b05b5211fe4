"""Best-fit packing of token sequences, certified by dual-feasible-function bounds.

Pieces are dealt into partitions of about ``PARTITION`` pieces. Each partition is
packed by best-fit decreasing and compared with a lower bound on any packing of
it: the largest ``ceil(sum of f(length))`` over a family of dual-feasible
functions f. Where the bin count equals the bound the partition is certified and
final. Partitions with a gap put their unfilled bins, and as many filled ones, into
a common pool that is dealt anew into fewer partitions, where the documents of all
bins of a partition are packed again. A partition keeps the better of both packings,
so no exchange loses anything; they end when the number of sequences reaches the
bound of the whole table, or after ``ROUNDS``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetpulse.llm.shared import materialise
from assetpulse.llm.tokens import encoder

CAPACITY = 1024
PARTITION = 16_384
ROUNDS = 6
#: Texts of so many characters are encoded before their pieces are handed on.
HAND_ON = 4 << 20


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` of ``docs(doc_id, text)``.

    A document is the ids of its text (null: empty) and then ``end_id``. One
    longer than ``capacity`` is cut into pieces of ``capacity``, of which the
    first may be shorter. ``ids`` are little-endian unsigned 32-bit integers.
    """
    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_all = encoder(vocabulary).encode_all
        end = int(end_id).to_bytes(4, "little")
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
        for part in parts:
            rows, size = [], 0
            for doc_id, raw in zip(part["doc_id"], encode_all(part["text"]), strict=True):
                raw += end
                n = len(raw) // 4
                first = n % capacity or capacity
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    length = first if k == 0 else capacity
                    ids = raw[4 * start : 4 * (start + length)]
                    rows.append((doc_id, k, start, length, zlib.crc32(ids), ids)[: len(names)])
                size += len(raw)
                if size > HAND_ON:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


@lru_cache(maxsize=4)
def dual_feasible(capacity: int) -> np.ndarray:
    """Values of a family of dual-feasible functions at lengths 0 to ``capacity``, one function a row.

    Rounding u(k): x (k+1) where that is whole, else floor(x (k+1)) / k. Threshold
    f(e): 1 above capacity - e, 0 below e, else the share itself. Both map every
    set of lengths that fits one bin to at most 1.
    """
    x = np.arange(capacity + 1)
    rows = [x / capacity]
    for k in range(1, 65):
        whole = x * (k + 1) % capacity == 0
        rows.append(np.where(whole, x / capacity, (x * (k + 1) // capacity) / k))
    for e in range(1, capacity // 2 + 1):
        rows.append(np.where(x > capacity - e, 1.0, np.where(x < e, 0.0, x / capacity)))
    return np.array(rows)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins that any packing of ``lengths`` can have, by the best function of the family."""
    return _bound(np.bincount(lengths, minlength=capacity + 1), capacity)


def _bound(histogram: np.ndarray, capacity: int) -> int:
    return int(np.ceil((dual_feasible(capacity) @ histogram).max() - 1e-6))


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; a piece goes to the fullest bin that it fits."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0  # bit r is set where a bin has r tokens of room
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen, made = capacity, made, made + 1
        bins[i], offsets[i] = chosen, capacity - room
        if room > n:
            by_room[room - n].append(chosen)
            rooms |= 1 << (room - n)
    return bins, offsets


def _waste(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, int]:
    """Bins used, and (smaller is better) how evenly their room is spread: room in few bins takes further pieces."""
    room = capacity - np.bincount(bins, lengths).astype(np.int64)
    return len(room), -int((room * room).sum())


def pack(pieces_of: DataFrame, capacity: int = CAPACITY, partition: int = PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """``pieces_of`` (with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Pieces of one ``sequence_id`` lie gapless from offset 0 and hold at most
    ``capacity`` tokens. Every row is packed, repeated rows and null ids too: rows
    are dealt by a number fixed when they are written. Extra columns come along
    under any name; columns called ``sequence_id`` or ``offset`` are replaced. An
    empty table gives no rows.
    """
    columns = [c for c in pieces_of.columns if c not in ("sequence_id", "offset")]
    number = "row"
    while number in columns:
        number += "_"
    rows = materialise(pieces_of.select(*columns).withColumn(number, F.monotonically_increasing_id()), "pieces")
    # Only a number, a length and a bin travel between the partitions.
    narrow = rows.select(F.col(number).alias("row"), F.col("length").cast("int").alias("length"))
    by_length = dict(narrow.groupBy("length").count().collect())  # at most ``capacity`` rows
    count = sum(by_length.values())
    histogram = np.zeros(capacity + 1)
    histogram[list(by_length)] = list(by_length.values())
    bound = _bound(histogram, capacity)

    def packed(pool: DataFrame, deal: Column, turn: int, groups: int) -> DataFrame:
        """Each group packed anew; bins that come along stay as they are where that is no better."""
        def one(part: pd.DataFrame) -> pd.DataFrame:
            group = int(part["group"].iloc[0])
            lengths = part["length"].to_numpy(np.int64)
            bins, offsets = best_fit_decreasing(lengths, capacity)
            least = lower_bound(lengths, capacity)
            ids = (turn << 58) + (group << 24) + bins
            if turn > 1:
                _, old = np.unique(part["sequence_id"].to_numpy(), return_inverse=True)
                if _waste(old, lengths, capacity) <= _waste(bins, lengths, capacity):
                    bins, offsets, ids = old, part["offset"].to_numpy(), part["sequence_id"].to_numpy()
            fill = np.bincount(bins, lengths)[bins]
            return pd.DataFrame({"row": part["row"], "length": part["length"], "sequence_id": ids, "offset": offsets, "room": capacity - fill,
                                 "certified": bins.max() + 1 == least})

        dealt = pool.withColumn("group", F.pmod(deal, F.lit(groups)).cast("int"))
        return materialise(dealt.groupBy("group").applyInPandas(
            one, "row long, length int, sequence_id long, offset long, room long, certified boolean"), "packed")

    # Dealt at random (the same way at every run).
    now = packed(narrow, F.xxhash64("row"), 1, max(1, -(-count // partition)))
    if count > partition:  # a lone partition has nobody to exchange with
        for turn in range(2, rounds + 1):
            if now.filter("offset = 0").count() <= bound:
                break
            # Whole bins change places: those with room, of partitions with a gap, and as many filled ones to combine with.
            heads = now.filter("offset = 0 and not certified")
            open_bins, full = heads.agg(F.coalesce(F.sum((F.col("room") > 0).cast("long")), F.lit(0)), F.count("*")).first()
            if not open_bins:
                break
            share = min(1.0, open_bins / max(1, full - open_bins))
            drawn = F.pmod(F.xxhash64("sequence_id", F.lit(-turn)), F.lit(1 << 20)) < share * (1 << 20)
            moves = ~F.col("certified") & ((F.col("room") > 0) | drawn)
            pool = now.filter(moves)
            groups = max(1, -(-pool.count() // partition))
            again = packed(pool, F.xxhash64("sequence_id", F.lit(turn)), turn, groups)
            now = materialise(now.filter(~moves).union(again), "packed")
    placed = now.select(F.col("row").alias(number), "sequence_id", "offset")
    return rows.join(placed, number).select(*columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids, pieces)``: the ids of every sequence and where its pieces lie (``packed`` has ``ids``)."""
    def join(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("offset")
        return pd.DataFrame({"sequence_id": [part["sequence_id"].iloc[0]], "ids": [b"".join(part["ids"])],
                             "pieces": [[{"doc_id": d, "piece": p, "offset": o, "length": n} for d, p, o, n in part[["doc_id", "piece", "offset", "length"]].itertuples(index=False)]]})

    return packed.groupBy("sequence_id").applyInPandas(
        join, "sequence_id long, ids binary, pieces array<struct<doc_id long, piece int, offset long, length long>>")

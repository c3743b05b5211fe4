"""Ranked lexical search by Block-Max MaxScore over an index of document shards.

``build_index`` writes an index that no query has a part in. A shard holds about
``SHARD_BYTES`` of text: for each of its terms the ascending documents with their
counts, in blocks of ``BLOCK`` postings (variable-length bytes, a block readable
alone) and for each block its last document and the best pairs (count, document
length): those that no other pair of the block beats in both. A posting's score
grows with the count and falls with the length, so the largest score over these
pairs is the block's exact maximum, whatever the statistics of the whole table.

``search`` answers items in blocks of bounded size. A first pass over the shards'
term lists sums the document frequencies, a second one searches each shard:

1. An item's lists are taken by falling global bound (weight times the largest
   block maximum). Once the bounds of the lists left do not add up to the
   item's threshold, the rest are non-essential: a document that only they hold
   cannot enter the heap.
2. Documents of the essential lists whose score and remaining bounds reach the
   threshold are looked up in the non-essential lists, one list after another. A
   document's block maximum there replaces the list's bound, and those that fall
   below the threshold are rejected before their block is decompressed.
3. A task keeps one heap an item over its shards, so thresholds rise as it goes
   on; the heaps of all tasks are merged.

Terms are maximal runs of characters outside
``[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]``, A-Z lower-cased. The class is ASCII, so the
scan works on UTF-8 bytes. A term is found by a 64-bit hash and its bytes are
compared; within one shard terms are told apart by the hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetpulse.llm.shared import bounded_batches, materialise
from assetpulse.llm.textscan import _CODE, _LOWER, _POWERS, mix

BLOCK = 128
#: A shard is closed beyond so many bytes of text or documents; texts are scanned in parts of about PART_BYTES.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 16
PART_BYTES = 1 << 20
#: Items are searched together up to about so many of their terms.
ITEM_TERMS = 200_000
_U = np.uint64
_TERM = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])
_NONE = np.iinfo(np.int64).max


def _parts(texts, limit: int = PART_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """Runs of ``(position, bytes)`` of about ``limit`` bytes; a longer text is cut between terms."""
    run, size = [], 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        at = 0
        while at < len(raw) or not at:
            end = min(len(raw), at + limit)
            while end < len(raw) and _TERM[raw[end]]:  # a term is never cut
                end += 1
            if run and size + end - at > limit:
                yield run
                run, size = [], 0
            run.append((i, raw[at:end]))
            size += end - at
            at = max(end, 1)
    if run:
        yield run


def _scan(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each term in order: text, hash, start and end in the joined bytes; then those bytes."""
    buf = np.frombuffer((b" ".join(texts) + b" ").translate(_LOWER), np.uint8)
    inside = _TERM[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    up, down = _POWERS.get(len(buf) + 1)
    run = np.zeros(len(buf) + 1, _U)
    np.cumsum(_CODE[buf] * up[: len(buf)], out=run[1:])
    h = mix((run[end] - run[start]) * down[start] + (end - start).astype(_U))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return np.searchsorted(ends, start, side="right"), h, start, end, buf


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each run of ``counts`` places, one run after another."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the last byte of a value marked; and where each value ends."""
    v = values.astype(_U)
    width = np.ones(len(v), np.int64)
    for k in range(1, 5):
        width += v >= _U(1 << 7 * k)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        has = width > k
        out[ends[has] - width[has] + k] = (v[has] >> _U(7 * k)) & _U(127)
    out[ends - 1] |= 128
    return out, ends


def _from_bytes(raw: np.ndarray) -> np.ndarray:
    last = raw >= 128
    ends = np.flatnonzero(last)
    begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    place = np.arange(len(raw)) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), begins) if len(ends) else np.empty(0, np.int64)


class _Shard:
    """Postings of documents that are added in order, and their index row."""

    def __init__(self):
        self.ids, self.lengths, self.bytes = [], [], 0
        self.postings, self.names = [], []

    def add(self, texts: list[tuple[int, bytes]], first: int) -> None:
        """Texts (or parts of texts) of documents ``first + position``."""
        text, h, start, end, buf = _scan([t for _, t in texts])
        doc = np.array([first + i for i, _ in texts], np.int64)[text] if len(text) else text
        order = np.lexsort((doc, h))
        h, doc, start, end = h[order], doc[order], start[order], end[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        self.postings.append((h[at], doc[at].astype(np.uint32), np.diff(np.append(at, len(h))).astype(np.uint32)))
        at = at[np.concatenate(([True], h[at][1:] != h[at][:-1]))] if len(at) else at
        size = end[at] - start[at]
        self.names.append((h[at], size, buf[_spread(start[at], size)]))
        for i, _ in texts:
            while len(self.lengths) <= first + i:
                self.lengths.append(0)
        for d, n in zip(*np.unique(doc, return_counts=True)):
            self.lengths[d] += int(n)
        self.bytes += sum(len(t) for _, t in texts)

    def row(self) -> dict:
        h, doc, tf = (np.concatenate(x) for x in zip(*self.postings))
        order = np.argsort(h, kind="stable")  # documents stay in order
        h, doc, tf = h[order], doc[order].astype(np.int64), tf[order].astype(np.int64)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])  # parts of one text come together
        tf = np.add.reduceat(tf, np.flatnonzero(new)) if len(h) else tf
        h, doc = h[new], doc[new]
        begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
        df = np.diff(np.append(begin, len(h)))
        name_h, size, name = (np.concatenate(x) for x in zip(*self.names))
        _, pick = np.unique(name_h, return_index=True)
        name = name[_spread((np.cumsum(size) - size)[pick], size[pick])]
        # Blocks, numbered over all terms.
        blocks = -(-df // BLOCK)
        block_begin = _spread(np.zeros(len(df), np.int64), blocks) * BLOCK + np.repeat(begin, blocks)
        block = np.zeros(len(h), np.int64)
        block[block_begin[1:]] = 1
        block = np.cumsum(block)
        gap = doc.copy()
        gap[1:] -= np.where(block[1:] == block[:-1], doc[:-1], 0)
        raw, ends = _to_bytes(np.stack((gap, tf - 1), 1).ravel())
        block_end = np.append(block_begin[1:], len(h))
        length = np.asarray(self.lengths, np.int64)
        n = length[doc]
        order = np.lexsort((n, -tf, block))
        least = np.minimum.accumulate(n[order] - (block[order] << 40)) if len(h) else n
        best = np.ones(len(h), bool)
        b = block[order]
        best[1:] = (b[1:] != b[:-1]) | (least[1:] < least[:-1])
        best = order[best]
        with_terms = length > 0
        packed = lambda x, kind: np.ascontiguousarray(x, kind).tobytes()
        return {"n_docs": int(with_terms.sum()), "n_terms": int(length.sum()),
                "doc_ids": packed([_NONE if d is None else d for d in self.ids], "<i8"), "lengths": packed(length, "<u4"),
                "hashes": packed(h[begin], "<u8"), "df": packed(df, "<u4"), "name_sizes": packed(size[pick], "<u4"), "names": name.tobytes(),
                "last": packed(doc[block_end - 1], "<u4"), "ends": packed(ends[2 * block_end - 1], "<u8"),
                "best": packed(np.bincount(block[best], minlength=len(block_begin)), "<u2"),
                "best_tf": packed(tf[best], "<u4"), "best_n": packed(n[best], "<u4"), "postings": raw.tobytes()}


INDEX = ("n_docs long, n_terms long, doc_ids binary, lengths binary, hashes binary, df binary, name_sizes binary, names binary, "
         "last binary, ends binary, best binary, best_tf binary, best_n binary, postings binary")


def build_index(docs: DataFrame) -> DataFrame:
    """The index of ``docs(doc_id, text)``: one row a shard, written to the shared folder.

    Every row is a document of its own, repeated ones too. A null or empty text
    has no terms. Other columns are not read. An empty table gives no shards.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = _Shard()
        for part in parts:
            ids = [None if pd.isna(d) else int(d) for d in part["doc_id"]]
            first, seen = len(shard.ids), 0
            for texts in _parts(part["text"]):
                # Close between documents only: a run may begin inside one.
                if texts[0][0] >= seen and (shard.bytes >= SHARD_BYTES or len(shard.ids) >= SHARD_DOCS):
                    yield pd.DataFrame([shard.row()])
                    shard, first = _Shard(), -texts[0][0]
                top = texts[-1][0] + 1
                shard.ids += ids[max(seen, texts[0][0]) : top]
                seen = top
                shard.add(texts, first)
        if shard.ids:
            yield pd.DataFrame([shard.row()])

    bounded_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(read.mapInPandas(run, INDEX), "search-index")


def _array(row, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(row[name], kind)


def _places(row, wanted: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Where the wanted terms stand among a shard's terms, or -1: hash first, then bytes."""
    hashes, size = _array(row, "hashes", "<u8"), _array(row, "name_sizes", "<u4").astype(np.int64)
    if not len(hashes):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    ends, names = np.cumsum(size), row["names"]
    place = np.full(len(wanted), -1)
    for i in np.flatnonzero(hashes[at] == wanted).tolist():
        end = int(ends[at[i]])
        if names[end - int(size[at[i]]) : end] == words[i]:
            place[i] = at[i]
    return place


class _List:
    """One term's postings in one shard: block maxima at once, documents and scores block by block."""

    def __init__(self, shard: _Lists, term: int, weight: int):
        self.shard, self.df = shard, int(shard.df[term])
        self.block0, self.block1 = int(shard.first[term]), int(shard.first[term + 1])
        a, b = int(shard.best_at[self.block0]), int(shard.best_at[self.block1])
        score = weight * shard.factor(shard.best_tf[a:b], shard.norm_of(shard.best_n[a:b]))
        self.maxima = np.maximum.reduceat(score, shard.best_at[self.block0 : self.block1] - a)
        self.bound, self.weight = int(self.maxima.max()), weight
        self.last = shard.last[self.block0 : self.block1]
        self.open = np.zeros(len(self.last), bool)
        # Unopened places hold their block's last document, which keeps the order.
        self.docs = np.repeat(self.last, BLOCK)[: self.df] if len(self.last) == 1 else np.repeat(
            self.last, np.append(np.full(len(self.last) - 1, BLOCK), self.df - BLOCK * (len(self.last) - 1)))
        self.score = np.zeros(self.df, np.int64)

    def decompress(self, blocks: np.ndarray) -> None:
        blocks = blocks[~self.open[blocks]]
        if not len(blocks):
            return
        s, b = self.shard, blocks + self.block0
        begin = np.where(b > 0, s.ends[b - 1], 0)
        v = _from_bytes(s.postings[_spread(begin, s.ends[b] - begin)])
        gap, tf = v[0::2], v[1::2] + 1
        count = np.minimum(BLOCK, self.df - blocks * BLOCK)
        # Documents are gaps within a block: a running sum that starts anew with each.
        total = np.cumsum(gap)
        head = np.cumsum(count) - count
        doc = total - np.repeat(total[head] - gap[head], count)
        at = _spread(blocks * BLOCK, count)
        self.docs[at] = doc
        self.score[at] = self.weight * s.factor(tf, s.norm[doc])
        self.open[blocks] = True

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        self.decompress(np.arange(len(self.last)))
        return self.docs, self.score


class _Lists:
    """One shard, ready to be searched."""

    def __init__(self, row, n: int, total: int):
        a = lambda name, kind="<u4": _array(row, name, kind).astype(np.int64)
        self.n, self.total = n, total
        self.df, self.last, self.ends = a("df"), a("last"), a("ends", "<u8")
        self.first = np.concatenate(([0], np.cumsum(-(-self.df // BLOCK))))
        self.best_at = np.concatenate(([0], np.cumsum(a("best", "<u2"))))
        self.best_tf, self.best_n = a("best_tf"), a("best_n")
        self.postings = _array(row, "postings", np.uint8)
        self.doc_ids, self.norm = _array(row, "doc_ids", "<i8"), self.norm_of(a("lengths"))
        self.cache: dict[int, _List] = {}

    def norm_of(self, length: np.ndarray) -> np.ndarray:
        return 8 * (100 - 90 + (90 * length * self.n) // self.total)

    @staticmethod
    def factor(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + norm)

    def get(self, place: int, weight: int) -> _List:
        if place not in self.cache:
            self.cache[place] = _List(self, place, weight)
        return self.cache[place]


def _best(score: np.ndarray, doc_id: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((doc_id, -score))[:k]


def search_shard(shard: _Lists, lists: list[_List], k: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (places in the shard) and scores that may belong to an item's best ``k``; none below ``threshold``."""
    lists = sorted((x for x in lists if x.bound > 0), key=lambda x: -x.bound)
    rest = np.concatenate((np.cumsum([x.bound for x in lists][::-1])[::-1], [0])).astype(np.int64)
    if not lists or rest[0] < threshold:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    total = np.zeros(len(shard.norm), np.int64)
    at, used = 0, 0
    while at < len(lists) and (rest[at] >= threshold or not at):  # essential lists
        docs, score = lists[at].whole()
        total[docs] += score
        at += 1
        used += len(docs)
        if at < len(lists) and used >= k and len(total) > k:
            threshold = max(threshold, int(np.partition(total, -k)[-k]))
    found = np.flatnonzero((total > 0) & (total + rest[at] >= threshold))
    score = total[found]
    for i in range(at, len(lists)):  # non-essential lists
        if len(found) > k:
            threshold = max(threshold, int(np.partition(score, -k)[-k]))
        keep = score + rest[i] >= threshold
        found, score = found[keep], score[keep]
        if not len(found):
            break
        x = lists[i]
        block = np.searchsorted(x.last, found)
        inside = block < len(x.last)
        most = np.where(inside, x.maxima[np.minimum(block, len(x.last) - 1)], 0)
        keep = score + most + rest[i + 1] >= threshold
        found, score, block, inside = found[keep], score[keep], block[keep], inside[keep]
        x.decompress(np.unique(block[inside]))
        place = np.minimum(np.searchsorted(x.docs, found), x.df - 1)
        hit = inside & (x.docs[place] == found)
        score = score + np.where(hit, x.score[place], 0)
    keep = (score >= threshold) & (score > 0)
    found, score = found[keep], score[keep]
    pick = _best(score, shard.doc_ids[found], k)
    return found[pick], score[pick]


def _item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term, hash)``, once each."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids = part["item_id"].to_numpy()
            for texts in _parts(part["text"]):
                text, h, start, end, buf = _scan([t for _, t in texts])
                raw = buf.tobytes()
                yield pd.DataFrame({"item_id": ids[[texts[i][0] for i in text]], "term": [raw[a:b] for a, b in zip(start, end)],
                                    "hash": h.view(np.int64)})

    read = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null")
    return read.mapInPandas(run, "item_id long, term binary, hash long").distinct()


def _frequencies(index: DataFrame, hashes: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Documents that hold each of a block of terms, over all shards."""
    sent = index.sparkSession.sparkContext.broadcast((hashes, words))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, names = sent.value
        df = np.zeros(len(wanted), np.int64)
        for part in parts:
            for row in part.to_dict("records"):
                place = _places(row, wanted, names)
                df[place >= 0] += _array(row, "df", "<u4")[place[place >= 0]]
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": at, "df": df[at]})

    counted = index.select("hashes", "df", "name_sizes", "names").mapInPandas(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(len(words), np.int64)
    for term, df in counted.collect():  # a row for each term of the block at most
        out[term] = df
    sent.unpersist()
    return out


def _search_block(index: DataFrame, terms: DataFrame, n: int, total: int, k: int) -> DataFrame:
    """The best documents of a block of items."""
    rows = terms.orderBy("hash", "term", "item_id").collect()  # bounded: see ITEM_TERMS
    words, number, of_item = [], {}, {}
    for r in rows:
        t = bytes(r.term)
        if t not in number:
            number[t] = len(words)
            words.append((t, r.hash))
        of_item.setdefault(r.item_id, []).append(number[t])
    hashes, names = np.array([h for _, h in words], np.int64).view(_U), [t for t, _ in words]
    df = _frequencies(index, hashes, names)
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df]
    sent = index.sparkSession.sparkContext.broadcast((hashes, names, weight, of_item))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, named, weights, members = sent.value
        heaps = {i: (np.empty(0, np.int64), np.empty(0, np.int64)) for i in members}
        for part in parts:
            for row in part.to_dict("records"):
                place = _places(row, wanted, named).tolist()
                shard = _Lists(row, n, total)
                for item, own in members.items():
                    score, doc_id = heaps[item]
                    lists = [shard.get(place[t], weights[t]) for t in own if place[t] >= 0]
                    found, more = search_shard(shard, lists, k, int(score[-1]) if len(score) == k else 0)
                    if len(found):
                        score, doc_id = np.concatenate((score, more)), np.concatenate((doc_id, shard.doc_ids[found]))
                        pick = _best(score, doc_id, k)
                        heaps[item] = score[pick], doc_id[pick]
        got = [(i, d if d != _NONE else None, s) for i, (score, ids) in heaps.items() for s, d in zip(score.tolist(), ids.tolist())]
        yield pd.DataFrame(got, columns=["item_id", "doc_id", "score"]).astype({"doc_id": "Int64"})

    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    merged = index.select("doc_ids", "lengths", "hashes", "df", "name_sizes", "names", "last", "ends", "best", "best_tf", "best_n", "postings")
    merged = merged.mapInPandas(run, "item_id long, doc_id long, score long").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return materialise(merged.select("item_id", "rank", "doc_id", "score"), "ranked")


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents for each of ``items(item_id, text)``.

    Scores above 0 only; equal scores rank by ascending doc_id, documents without
    one last. Rows that repeat an item_id are one item with the terms of all of
    them; a null item_id, or an item without terms, gives no rows. Repeated
    documents rank each on its own. Other columns are not read; empty tables give no rows.
    """
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    terms = materialise(_item_terms(items), "item-terms")
    count = terms.count() if n else 0
    blocks = -(-count // ITEM_TERMS)
    out = None
    for b in range(blocks):
        some = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        found = _search_block(index, some, n, total, k)
        out = found if out is None else out.union(found)
    return out if out is not None else items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``search`` over a new index of ``docs(doc_id, text)``."""
    return search(build_index(docs), items, k)

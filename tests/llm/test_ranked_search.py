"""Block-Max MaxScore against a plain ranking of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from assetpulse.llm import ranked_search as rs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    lengths = [sum(c.values()) for _, c in counts]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    merged = {}
    for i, t in items:
        if i is not None:
            merged.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in merged.items():
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in own}
        scored = []
        for (d, c), length in zip(counts, lengths):
            m = 100 - 90 + (90 * length * n) // total if total else 0
            s = sum(w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out)


def texts(rng, n, words):
    vocabulary = [f"w{i}" for i in range(words)] + ["é", "ÀB", "日本", "naïve", "A1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [rng.choice([" ", "-", "\x00", "_\n"]).join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 5, 40, 400]))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_ranking(spark, monkeypatch, seed):
    rng = random.Random(seed)
    made = texts(rng, 900, [60, 500, 3000][seed])
    docs = [(i if i % 50 else None, t) for i, t in enumerate(made)] + [(7, made[7]), (7, "w1"), (2000, None), (2001, "")]
    docs += [(3000 + i, "w0 w1 w2 rare") for i in range(400)]  # ties
    items = [(i, t[:200]) for i, t in enumerate(texts(rng, 25, 400))] + [(90, "rare w0"), (90, "w3"), (91, None), (92, "!!"), (None, "w1"), (93, "nowhere")]
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, postings string, n_docs int").repartition(3)
    it = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, rank int")
    got = sorted((tuple(r) for r in rs.rank_documents(df, it).collect()), key=lambda r: (r[0], r[1]))
    assert got == plain(docs, items, 10)


def test_shards_blocks_of_items_and_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    made = texts(rng, 300, 300) + [" ".join(texts(rng, 200, 900)), "z" * 70_000 + " w1 w2"]
    docs, items = list(enumerate(made)), list(enumerate(texts(rng, 12, 200)))
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    parts = list(rs._parts(made, 1000))
    assert all(b"".join(b for p in parts for j, b in p if j == i) == t.encode() for i, t in enumerate(made))
    monkeypatch.setattr(rs, "ITEM_TERMS", 60)
    rows = []
    for shards in (rs.build_index(df), rs.build_index(df.repartition(7))):
        rows.append(sorted((tuple(r) for r in rs.search(shards, spark.createDataFrame(items, "item_id long, text string"), 4).collect())))
    assert rows[0] == rows[1] == plain(docs, items, 4)


def test_shard_in_small_parts_equals_one_part():
    rng = random.Random(3)
    made = texts(rng, 200, 500) + [" ".join(texts(rng, 60, 900))]
    rows = []
    for limit in (1 << 20, 700):
        shard = rs._Shard()
        shard.ids = list(range(len(made)))
        for part in rs._parts(made, limit):
            shard.add(part, 0)
        rows.append(shard.row())
    assert rows[0] == rows[1]


def test_non_essential_blocks_stay_compressed():
    rng = random.Random(4)
    shard = rs._Shard()
    made = [f"common{' common' * rng.randrange(3)} w{rng.randrange(40)}" + " filler" * rng.randrange(200) for _ in range(4000)]
    made[2500] += " rare rare rare"
    shard.ids = list(range(len(made)))
    for part in rs._parts(made):
        shard.add(part, 0)
    row = shard.row()
    lists = rs._Lists(row, row["n_docs"], row["n_terms"])
    _, h, start, end, buf = rs._scan([b"common rare w5"])
    place = rs._places(row, h, [buf.tobytes()[a:b] for a, b in zip(start, end)])
    df = lists.df[place]
    own = [lists.get(int(p), math.floor(1000 * math.log((2 * 4000 + 2) / (2 * int(d) + 1)))) for p, d in zip(place, df)]
    found, score = rs.search_shard(lists, own, 1, 0)
    assert found.tolist() == [2500] and own[0].open.sum() < len(own[0].open)


def test_block_maxima_are_exact():
    rng = random.Random(5)
    made = texts(rng, 600, 80)
    shard = rs._Shard()
    shard.ids = list(range(len(made)))
    for part in rs._parts(made):
        shard.add(part, 0)
    row = shard.row()
    lists = rs._Lists(row, row["n_docs"], row["n_terms"])
    for term in range(len(lists.df)):
        x = lists.get(term, 3)
        docs, score = x.whole()
        assert (np.diff(docs) > 0).all()
        assert x.maxima.tolist() == [int(score[b * rs.BLOCK : (b + 1) * rs.BLOCK].max()) for b in range(len(x.last))]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    item = some.withColumnRenamed("doc_id", "item_id")
    assert rs.rank_documents(none, item).count() == 0
    assert rs.rank_documents(some, item.limit(0)).count() == 0
    assert rs.rank_documents(some, item).count() == 1

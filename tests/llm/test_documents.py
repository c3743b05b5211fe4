"""Text operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from assetpulse.llm import decontamination, language_model, near_dedup, packing, quality, sharding, textscan, token_files, tokens

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("the", "Ond", "éré", "ti", "sh") for b in range(40)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 200))) for _ in range(n)]
    for k in range(0, 20):
        w = texts[k].split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40))) for _ in range(15)]
    texts += [texts[0]] * 3 + ["", None, "  \t\n", "a b", "A  b", "one two three four five", "x" * 5000, " ".join(texts[:40])]
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", i, 1.0) for i, t in corpus()] + [(None, "no id here at all", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, digest long, __group double").repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string, digest long, __group double")


def test_scan_equals_regular_expression():
    for _, t in corpus():
        _, start, end, h, joined = textscan.scan([(t or "").encode()])
        assert [joined[a:b].decode() for a, b in zip(start, end)] == words(t)
        assert len(set(h.tolist())) == len(set(words(t)))
        assert len(textscan.shingle_sets([b"q", (t or "").encode()])[1]) == len(shingles(t))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoder_equals_the_library(name):
    e = tokens.Encoder(tokens.vocabulary(name))
    odd = ["<|endoftext|> a", "İstanbul ΑΣ", "é 漢字", "x\x1cy", "don't I'LL 12 ¼ x²", " \n\n a\t b", "a\x85b\xa0c"]
    for t in [t or "" for _, t in corpus()] + odd:
        assert e.encode(t) == e.whole(t)


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    low = {i: i for i in sets}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= 75 * len(sets[x] | sets[y]):
                    a, b = sorted((top(x), top(y)))
                    low[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_duplicates(spark, docs, nothing):
    got = near_dedup.near_duplicates(docs).collect()
    want = brute_components(corpus())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got) and len(got) == docs.count()
    left = near_dedup.deduplicated(docs)
    assert left.columns == docs.columns and left.count() == 1 + len({c for _, c in want.values()})
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_near_copies_of_one_text_in_mixed_lists(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(120):  # edits of very different extent around one text, so that components stay apart
        w = list(base)
        for i in rng.sample(range(150), rng.choice([0, 2, 4, 8, 12, 20])):
            w[i] = f"v{rng.randrange(400)}"
        rows.append((k, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows)


def test_decontamination(spark, docs, nothing):
    rows = corpus()
    items = [(k, " ".join(rows[k][1].split()[:30])) for k in range(8)] + [(90, None), (91, ""), (92, "a b"), (None, "a b c d e f")]
    items += [(93, " ".join(random.Random(9).choice(["qq", "zz", "yy"]) for _ in range(20)))]
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): (r.item_shingles, r.shared) for r in decontamination.contaminated(docs, bench).collect()}
    want = {}
    for d, t in rows:
        for k, x in items:
            s, both = shingles(x), len(shingles(x) & shingles(t))
            if k is not None and s and 100 * both >= 75 * len(s):
                want[d, k] = (len(s), both)
    assert got == want and want
    left = decontamination.decontaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - len({d for d, _ in want})
    assert decontamination.contaminated(nothing, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert "Python" not in decontamination.contaminated(docs, bench)._jdf.queryExecution().toString()


def test_quality_learns_and_scores(spark, nothing):
    rng = random.Random(2)
    good = ["the", "of", "and", "on", "reed", "stone"]
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        t = " ".join(["zap!!"] * 20 + [rng.choice(good)]) if bad else " ".join(rng.choice(good) for _ in range(25))
        rows.append((i, t, "clash"))
        labels.append((i, None if i % 50 == 7 else int(not bad), 0))
    rows += [(1000, None, None), (1001, "", None), (None, "the of", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit_labelled(table, marks)
    got = model.score(table, "__quality").collect()
    assert len(got) == len(rows) and all(0 <= r["__quality"] <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 240 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([(r["__quality"] >= 0.7) == (r.doc_id % 3 != 0) for r in held]) > 0.95
    empty = {r["__quality"] for r in got if not r.text}
    assert len(empty) == 1
    assert model.score(nothing).count() == 0
    assert quality.fit_labelled(table, marks.limit(0)).score(table).select("score").distinct().collect()[0][0] == 0.5


def test_packing(spark, docs, nothing):
    path = tokens.vocabulary("byte_bpe_50k.json")
    cut = packing.pieces(docs, path, 2, with_ids=True)
    got = packing.pack(cut).collect()
    library = tokens.Encoder(path).whole
    by_doc = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length <= 4096
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in corpus() + [(None, "no id here at all")]:
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert b"".join(p.ids for p in parts) == library(t or "") + (2).to_bytes(4, "little")
        assert [p.start for p in parts] == list(np.cumsum([0] + [p.length for p in parts[:-1]]))
        assert all(p.length == 1024 for p in parts[1:])
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0] + [n for _, n in s[:-1]])) and sum(n for _, n in s) <= 1024
    assert len(seqs) <= 1 + packing.lower_bound(np.array([r.length for r in got]))
    joined = packing.sequences(packing.pack(cut)).collect()
    assert sum(len(r.ids) for r in joined) == 4 * sum(r.length for r in got)
    assert packing.pack(packing.pieces(nothing, path, 2)).count() == 0


def test_exchange_between_partitions_saves_sequences(spark):
    rng = random.Random(4)
    rows = [(i, 0, 0, rng.choice([200, 333, 341, 400, 512, 700, 1024]), 0) for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    many = packing.pack(table, partition=50).select("sequence_id").distinct().count()
    alone = packing.pack(table, partition=50, rounds=1).select("sequence_id").distinct().count()
    one = packing.pack(table, partition=10_000).select("sequence_id").distinct().count()
    assert one <= many <= alone and many <= 1.01 * one + 2


def test_dual_feasible_bounds_hold():
    rng = np.random.default_rng(1)
    for _ in range(40):
        x = rng.integers(1, 25, rng.integers(1, 40))
        bins, offsets = packing.best_fit_decreasing(x, 24)
        assert np.bincount(bins, x).max() <= 24 and packing.lower_bound(x, 24) <= bins.max() + 1
        for b in range(bins.max() + 1):
            assert packing.lower_bound(x[bins == b], 24) <= 1  # what fits one bin is never bounded above one
    assert packing.lower_bound(np.array([13, 13, 13]), 24) == 3
    assert packing.lower_bound(np.empty(0, int), 24) == 0


def test_token_files(spark, docs, nothing, monkeypatch):
    monkeypatch.setattr(token_files, "LEAST", 4)
    path = tokens.vocabulary("word_bpe_49k.json")
    folder = token_files.scratch(spark, "test-ids")
    files = token_files.write_token_files(docs, path, 2, folder)
    got = token_files.read_token_files(files, folder, with_ids=True).collect()
    library, at = tokens.Encoder(path).whole, 0
    rows = [(None, "no id here at all")] + corpus()
    mine = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i, t in rows:
        raw = library(t or "") + (2).to_bytes(4, "little")
        r = mine[i]
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(raw) // 4, zlib.crc32(raw), raw)
        at += r.n_tokens
    one = files.orderBy("start").first()
    system, _ = token_files._filesystem(folder)
    first = token_files.read_document(system, one.file, 0)
    assert first.astype("<u4").tobytes() == library("no id here at all") + (2).to_bytes(4, "little")
    assert token_files.token_file_round_trip(nothing, path, 2).count() == 0


def test_pairs_are_counted_without_sorting_every_place(monkeypatch):
    rng, unique, sizes = np.random.default_rng(5), np.unique, []
    key = rng.integers(0, 300, 20_000).astype(np.uint64) << np.uint64(32) | rng.integers(0, 3, 20_000).astype(np.uint64)
    for slots in (1, 40, 1 << 20):  # all keys in one slot, many in each, one in each
        slot = (unique(key, return_inverse=True)[1] % slots).astype(np.int64)
        for mine, its in zip(token_files._counted(key, slot), unique(key, return_inverse=True, return_counts=True), strict=True):
            assert (mine == its).all()
    ids = np.minimum(rng.geometric(0.05, 200_000), 200).astype(np.uint32)
    monkeypatch.setattr(np, "unique", lambda x, *a, **b: sizes.append(len(x)) or unique(x, *a, **b))
    g = token_files.compress(ids, np.arange(0, len(ids), 1000))
    monkeypatch.undo()
    assert len(g["left"]) > 1000 and (token_files.decode(g, g["symbols"]) == ids).all()
    assert max(sizes) < len(ids) // 10


def test_grammar_round_trip_and_compression(monkeypatch):
    monkeypatch.setattr(token_files, "LEAST", 3)
    rng = np.random.default_rng(0)
    phrase = rng.integers(0, 70_000, 12)
    ids = np.concatenate([np.concatenate((phrase, rng.integers(0, 9, 3), [7] * 9)) for _ in range(200)]).astype(np.uint32)
    starts = np.arange(0, len(ids), 24)
    g = token_files._unpack(token_files._pack(token_files.compress(ids, starts)))
    assert (token_files.decode(g, g["symbols"]) == ids).all() and len(g["symbols"]) < len(ids) / 3
    ends = np.append(g["places"], len(g["symbols"]))
    for k in (0, 5, 199):
        assert (token_files.decode(g, g["symbols"][ends[k] : ends[k + 1]]) == ids[24 * k : 24 * k + 24]).all()
    for small in (np.empty(0, np.uint32), np.array([5], np.uint32)):
        g = token_files._unpack(token_files._pack(token_files.compress(small, np.arange(len(small)))))
        assert (token_files.decode(g, g["symbols"]) == small).all()


def test_sharding(spark, docs, nothing):
    got = sharding.shard_by_bytes(sharding.document_records(docs), 7).collect()
    rows = sorted([(-1, "no id here at all")] + corpus())
    sizes = [len((t or "").encode()) + 16 for _, t in rows]
    total, before, want = sum(sizes), 0, {}
    for (i, t), n in zip(rows, sizes):
        want[i] = (n, zlib.crc32((t or "").encode()), min(6, before * 7 // total))
        before += n
    assert {-1 if r.doc_id is None else r.doc_id: (r["size"], r.text_crc32, r.shard) for r in got} == want
    for s in range(7):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(sharding.document_records(nothing), 7).count() == 0


def test_sharding_splits_a_hot_key(spark):
    rows = [(5 if i % 3 else (None if i % 2 else i), 10 + i % 7) for i in range(3000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "key long, size long").repartition(5), 10).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == 3000 and sizes.max() - sizes.min() <= 2 * 16
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])


@pytest.mark.parametrize("task_tokens, frequent", [(1 << 20, 2.0**-17), (500, 0.01), (500, 2.0)])
def test_language_model(spark, docs, nothing, monkeypatch, task_tokens, frequent):
    """One task and many; all words frequent, some with several slices, none."""
    monkeypatch.setattr(language_model, "TASK_TOKENS", task_tokens)
    monkeypatch.setattr(language_model, "FREQUENT", frequent)
    rows = [(i, t) for i, t in corpus()] + [(None, "no id here at all")]
    tok = {i: words(t) + ["\0"] for i, t in rows}
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, t in tok.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = language_model.score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        t = tok[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    assert language_model.score(nothing).count() == 0


def test_language_model_predictions_sum_to_one(spark):
    """One-word texts: P(w | start) P(end | w) over all known words and an unknown one, against texts of no words."""
    rng = random.Random(1)
    train = [(i, " ".join(rng.choice("abcdef") for _ in range(6)), False) for i in range(80)]
    probe = [(1000 + k, w, True) for k, w in enumerate("abcdef")] + [(2000, "", True), (3000, "zzz", True)]
    from pyspark.sql import functions as F
    table = spark.createDataFrame(train + probe, "doc_id long, text string, h boolean")
    p = {r.doc_id: 10 ** r.score for r in language_model.score(table, F.col("h")).collect()}
    # P(end | start) + sum of P(w | start): take each P(end | w) out by two-word texts
    two = spark.createDataFrame(train + [(1000 + k, f"{w}", True) for k, w in enumerate("abcdef")]
                                + [(5000 + 10 * j + k, f"{w} {x}", True) for j, w in enumerate("abcdef") for k, x in enumerate("abcdef")], "doc_id long, text string, h boolean")
    q = {r.doc_id: 10 ** r.score for r in language_model.score(two, F.col("h")).collect()}
    assert all(x > 0 for x in p.values()) and sum(v for k, v in p.items() if k < 2001 and k >= 1000) < 1
    assert sum(v for k, v in q.items() if k >= 1000) < 1
    assert p[3000] < min(p[1000 + k] for k in range(6))


def test_held_out_text_scores_above_the_base(spark):
    rng = random.Random(3)
    chain = {w: rng.sample("abcdefghij", 2) for w in "abcdefghij"}
    rows = []
    for i in range(300):
        w = [rng.choice("abcdefghij")]
        for _ in range(30):
            w.append(rng.choice(chain[w[-1]]))
        rows.append((i, " ".join(w)))
    got = language_model.score(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    out = got[got.held_out]
    assert out.score.sum() > 0.6 * out.base_score.sum()  # half of the choices at each step: far fewer bits


@pytest.mark.parametrize("task_tokens", [1 << 20, 900])
def test_contexts_that_are_not_frequent_have_restaurants_of_their_own(spark, monkeypatch, task_tokens):
    """No word is frequent, so every context's totals go by context between the tasks: scores as if all were."""
    rng = random.Random(3)
    chain = {w: rng.sample("abcdefghij", 2) for w in "abcdefghij"}
    rows = []
    for i in range(300):
        w = [rng.choice("abcdefghij")]
        for _ in range(30):
            w.append(rng.choice(chain[w[-1]]))
        rows.append((i, " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(language_model, "TASK_TOKENS", task_tokens)
    monkeypatch.setattr(language_model, "PLACE_TASKS", 2, raising=False)
    named = language_model.score(table).toPandas()
    monkeypatch.setattr(language_model, "FREQUENT", 2.0)
    got = language_model.score(table).toPandas()
    out = got[got.held_out]
    assert out.score.sum() > 0.6 * out.base_score.sum()
    assert out.score.sum() == pytest.approx(named[named.held_out].score.sum(), rel=0.01)


def test_seating_follows_the_process():
    rng = np.random.default_rng(0)
    t = language_model.seat(np.full(20_000, 5), np.full(20_000, 0.5), 0.3, rng)
    want, dist = 0.0, {1: 1.0}
    for n in range(1, 5):
        new = {}
        for k, p in dist.items():
            odds = 0.5 / (0.5 + n - 0.3 * k)
            new[k + 1] = new.get(k + 1, 0) + p * odds
            new[k] = new.get(k, 0) + p * (1 - odds)
        dist = new
    want = sum(k * p for k, p in dist.items())
    assert abs(t.mean() - want) < 0.02 and t.min() >= 1 and t.max() <= 5
    assert (language_model.seat(np.array([0, 1, 1000]), np.full(3, 2.0), 0.5, rng)[:2] == [0, 1]).all()


def test_runs_of_words_are_not_normalised_and_split_again():
    e = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"))
    words = sorted({w for w in e.split("".join(sorted(e.plain)).lower() + " don't 4711 it's zürich, ÿ... Œuvre".lower())})
    assert e.runs.normalizer is None and e._joined(words, " ", lambda run, ids: np.flatnonzero(e.measure[ids]) + 1) == []
    assert all(e.cache[w] == e.whole(w) for w in words)


def test_encoder_equals_the_library_on_plain_and_african_letters(monkeypatch):
    from assetpulse.llm import tokens
    rng = random.Random(12)
    plain = [chr(c) for c in range(0x20, 0x250)]
    monkeypatch.setattr(tokens, "JOINED", 5)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = tokens.Encoder(tokens.vocabulary(name))
        texts = ["ƐA", "Ɩf", "Ʋb", "it's I'LL '' 's 12"]
        texts += ["".join(rng.choice(plain) if rng.random() < 0.6 else rng.choice("ab 's 't'rE 12\n\t  ƐƖƲ.,!İ日") for _ in range(rng.randrange(16))) for _ in range(8000)]
        for text in texts:
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_keeps_clashing_columns_and_spreads_equal_rows(spark):
    rows = [(1, 0, 0, 300, 0, 5, True, "g", 7.5)] * 500 + [(i, 0, 0, 100 + i % 800, 0, i, False, None, 0.0) for i in range(300)]
    names = "doc_id long, piece int, start long, length long, ids_crc32 long, bins long, final boolean, row string, `group` double, sequence_id int"
    df = spark.createDataFrame([(*r, 0) for r in rows], names)
    got = packing.pack(df, partition=60).collect()
    assert sorted((r.doc_id, r.length, r.bins, r.final, str(r.row), r.group) for r in got) == sorted((r[0], r[3], r[5], r[6], str(r[7]), r[8]) for r in rows)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 1024


def test_deduplicated_keeps_one_of_repeated_rows(spark):
    text = "one two three four five six seven"
    rows = [(4, text, 1)] * 3 + [(None, text, 2)] * 2 + [(3, text + " ", 3), (9, "", 4), (9, "", 4), (10, None, 5), (11, "other words here", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = near_dedup.deduplicated(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.row) for r in got.collect()) == [("10", 5), ("11", 6), ("3", 3), ("9", 4), ("9", 4)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_word_is_looked_up_once(name):
    """op2, op5: texts with new words are not walked and looked up a second time; plain ASCII texts are told by their flag."""
    class Counting(dict):
        reads = 0

        def get(self, *a):
            Counting.reads += 1
            return dict.get(self, *a)

        def __getitem__(self, key):
            Counting.reads += 1
            return dict.__getitem__(self, key)

    path = tokens.vocabulary(name)
    made = tokens.Encoder(path)
    made.cache = Counting()
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(200)) for _ in range(20)] + ["", "a", "x\x1cy", "é b"]
    words = sum(len(made.split(t)) for t in texts if not made.odd(t))
    got = list(made.encode_all(texts))
    assert Counting.reads <= words
    assert made.odd("x\x1cy") and not made.odd("x y") and not made.odd("é b")
    assert got == [made.whole(t) for t in texts]

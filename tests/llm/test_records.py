"""Pages, vectors and components against brute force."""

import base64
import hashlib
import random

import numpy as np
import pytest

from assetpulse.llm import chat, vector_dedup, warc
from assetpulse.llm.components import connected_components


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)] + [(600, k) for k in range(601, 650)]
    low = {}

    def top(x):
        low.setdefault(x, x)
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            low[y] = x
    df = spark.createDataFrame(edges + [(None, 5), (7, None)], "a long, b long")
    got = connected_components(df).collect()
    assert {r.node: r.component for r in got} == {x: top(x) for x in low} and len(got) == len(low)
    assert connected_components(df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    rng = random.Random(1)
    pages = [(i, f"http://h{i % 3}/{i}", f"<html>{rng.random()} seite é {'x' * rng.randrange(3000)}</html>", "c") for i in range(60)]
    pages += [(100 + i, None, "<p>copy</p>", None) for i in range(9)] + [(120, "u", None, ""), (121, "u", "", ""), (None, "v", "<p>copy</p>", "")]
    pages += [(7, "again", pages[7][2], ""), (130, "http://a\r\nb/ c", "y" * 400_000, "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload string").repartition(4)
    got = warc.archive_round_trip(df).collect()
    top = {}
    for i, _, h, _ in pages:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h, _ in pages:
        raw = (h or "").encode()
        last = top[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if last == i else "revisit", None if last == i else last))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == sorted(want, key=key)
    assert {r.payload for r in got if r.page_id == 130} == {b"y" * 400_000}
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_archive_has_a_dictionary_and_separate_frames(spark):
    df = spark.createDataFrame([(i, "u", f"<html>{i} the same body of every page</html>") for i in range(50)], "page_id long, url string, html string")
    folder = warc.scratch(spark, "test-warc")
    index = warc.write_archives(df.coalesce(1), folder).orderBy("offset").collect()
    import zstandard as zstd
    path = index[0].file
    raw = open(path, "rb").read()
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_FRAME
    size = int.from_bytes(raw[4:8], "little")
    unpack = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw[8 : 8 + size]))
    for r in (index[3], index[49]):  # random access from the index alone
        fields, _, payload = warc.parse(unpack.decompress(raw[r.offset : r.offset + r.length]))
        assert fields["X-Page-Id"] == str(r.page_id) and payload == f"<html>{r.page_id} the same body of every page</html>".encode()


@pytest.mark.parametrize("block", [1024, 16])
def test_linked_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    monkeypatch.setattr(vector_dedup, "PER_LIST", 20)
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for c in range(30):
        centre = rng.normal(size=12)
        for _ in range(rng.integers(1, 14)):
            v = centre + rng.normal(size=12) * 0.12
            rows.append((k, [float(x) for x in np.float32(v)], int(c % 2) if k % 11 else None))
            k += 1
    rows += [(k + j, rows[1][1], rows[1][2]) for j in range(4)]
    k += 4
    odd = [None, [], [0.0] * 12, [1.0] * 11 + [None], [float("nan")] * 12, [float("inf")] + [1.0] * 11, [1.0, 2.0]]
    rows += [(k + j, v, 0) for j, v in enumerate(odd)] + [(None, rows[1][1], 0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, unit string")
    got = vector_dedup.linked_vectors(df).collect()

    def usable(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    good = [r for r in rows if usable(r)]
    links, low = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, a in enumerate(good):
        for b in good[i + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    p, q = sorted((top(a[0]), top(b[0])))
                    low[q] = p
    assert sum(links.values()) > 100
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == {
        i: (links[i], top(i), top(i) == i) for i in links if i is not None}
    assert vector_dedup.linked_vectors(df.limit(0)).count() == 0


def test_chat_keeps_maximal_conversations(spark):
    rng = random.Random(2)
    full = {c: [(rng.choice(["user", "bot"]), f"t{rng.randrange(4)}") for _ in range(rng.randint(1, 30))] for c in range(20)}
    for c in range(20, 50):
        src = full[rng.randrange(20)]
        full[c] = src[: rng.randint(1, len(src))]
    full[60] = [(None, None), ("user", None), ("user", "")]
    rows = [(c, i, r, t, "x") for c, l in full.items() for i, (r, t) in enumerate(l)] + [(None, 0, "user", "lost", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string").repartition(4)
    plain = {c: [(r or "", t or "") for r, t in l] for c, l in full.items()}
    keep = {c for c, l in plain.items() if not any(d != c and m[: len(l)] == l and (len(m) > len(l) or d < c) for d, m in plain.items())}
    got = chat.render(df).collect()
    text = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.position)):
        text[r.conv_id] = text.get(r.conv_id, "") + r.rendered
        assert r.n_turns == len(plain[r.conv_id])
    assert text == {c: "".join(chat.TEMPLATE % x for x in plain[c]) for c in keep} and len(keep) < 30
    assert chat.render(df.limit(0)).count() == 0

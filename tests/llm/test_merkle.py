"""The manifest, its proofs and the tampering trial against a plain Merkle tree."""

import hashlib
import random
import zlib

import pytest

from assetpulse.llm import merkle

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, i, digest):
    proof = []
    for level in tree[:-1]:
        a = i - i % 16
        run = level[a : a + 16]
        proof += run[: i - a] + run[i - a + 1 :]
        digest = H(*run[: i - a], digest, *run[i - a + 1 :])
        i //= 16
    return proof, digest


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in by[s]])
    upper = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            changed = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                changed = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            proof, digest = path(trees[s], i, changed)
            more, digest = path(upper, k, digest)
            out.append((r[0], leaf(r), trees[s][-1][0], upper[-1][0], H(*proof, *more), digest, digest == upper[-1][0]))
    return out


key = lambda r: tuple(str(x) for x in r)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], FIELDS + ", leaf string, block int").repartition(4)
    got = [tuple(r) for r in merkle.audit(df).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def table(rng, n, sources):
    text = lambda i: rng.choice([None, "", "Quick é Ä Brown", "lower", f"T{i} " * rng.randrange(30)])
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, i]), text(i)) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 16, 17])
def test_one_source(spark, n):
    check(spark, table(random.Random(n), n, ["s"]))


def test_sources_of_many_sizes_and_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 64)
    rng = random.Random(1)
    rows = table(rng, 700, ["hot"]) + table(rng, 300, [None, "", "é", "Z", "a", "b", "-"])
    rows += [(5000 + i, f"lone{i}", None, None, "One LEAF") for i in range(40)]
    rows += [rows[3], rows[3], (None, "hot", None, None, "Null ID"), (None, None, None, None, None), (9, "hot", "en", 1, "Same id, OTHER text")]
    check(spark, rows)


def test_very_long_text_and_empty_table(spark):
    check(spark, [(10, "a", "en", 5, "LONG é " * 300_000), (11, "b", "en", 5, "x")])
    assert merkle.audit(spark.createDataFrame([], FIELDS)).count() == 0


def test_tampering_is_found(spark):
    rows = [(i, f"s{i % 3}", "en", 1, "Has CAPITALS") for i in range(200)]
    got = merkle.audit(spark.createDataFrame(rows, FIELDS)).collect()
    assert {r.doc_id for r in got if not r.verified} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}

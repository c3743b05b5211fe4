"""Normalisation, ids and spans against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from assetpulse.llm import sentence_pieces as sp
from assetpulse.llm.tokens import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")


def _random_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    some = "ab cdE.  \n\t0▁éß日本ｆ①㌔ﬁ̈ꙮ😀　​­<s>"
    wide = [c for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    return ["".join(rng.choice(some) if rng.random() < 0.9 else chr(rng.choice(wide)) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_ids_and_spans_equal_the_library():
    library, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), sp.PieceModel(MODEL)
    for text in ["", " ", "  ", "▁", "a\0b", "Hello world", "x" * 5000, "日本語" * 2000, " lead", "trail  "] + _random_texts(4000, 1):
        ids, at = model.encode(text)
        want = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in want], text
        assert at[:-1].tolist() == [p.begin for p in want] and at[1:].tolist() == [p.end for p in want], text


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("flags", [(True, True, True), (True, False, True), (False, True, False), (False, False, False)])
def test_compiled_character_map_equals_the_library(rule, flags):
    dummy, squeeze, escape = flags
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, remove_extra_whitespaces=squeeze, escape_whitespaces=escape)
    ours = sp.Normaliser(theirs.serialized_normalizer_spec())
    for text in _random_texts(1500, 2) + ["", " ", "   a   b  ", "ｱﾞ ㌔", " x　"]:
        want, offsets = theirs.Normalize(text, with_offsets=True)
        raw = text.encode()
        got, origin = ours(raw)
        assert got.decode() == want, repr(text)
        # The library's offsets count characters of both texts.
        first = [len(raw[: origin[len(want[:i].encode())]].decode()) for i in range(len(want) + 1)]
        assert not want or first == list(offsets), repr(text)


def test_small_cache_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(sp, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(sp, "CACHE_CHARS", 4)
    model, library = sp.PieceModel(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in _random_texts(300, 3):
        assert model.encode(text)[0].tolist() == library.encode(text)


def test_round_trip_of_a_table(spark):
    texts = _random_texts(200, 4) + [None, "", "same", "same", "längere Wörter " * 20_000]
    rows = [(None if i == 7 else i // 2, t, "c", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for d, t, _, _ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([tuple(r) for r in sp.round_trip(df, MODEL).collect()], key=key) == sorted(want, key=key)
    assert sp.round_trip(df.limit(0), MODEL).count() == 0


def test_spans_cover_the_text_and_decode(spark):
    texts = ["one  two\nthree", "日本 ꙮ", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = sp.encode(df, MODEL)
    for r in encoded.collect():
        raw = (texts[r.doc_id] or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(r.starts, r.ends)) == raw
    assert {r.doc_id: r.text for r in sp.decode(encoded, MODEL).collect()} == {i: t or "" for i, t in enumerate(texts)}

"""Words, windows, encoding and packing against plain Python."""

import random
import re
import tracemalloc
import types
import weakref
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from workloom.llm import packing, toxicity
from workloom.llm.catalog import tokenizer_path
from workloom.llm.words import Words, chunks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def odd_texts(n=300):
    rng = random.Random(5)
    return ["", None, " ", "A", "don't  stop", "x" * 5000, "é É ß×÷", "a\x00b"] + [
        "".join(rng.choice("aB'sÉéß1!#<| \n\t́ İΣ中") for _ in range(rng.randrange(40))) for _ in range(n)]


def test_words_and_windows():
    texts = odd_texts()
    for row, data, offsets in chunks(pa.array(texts, pa.string())):
        words = Words(data, offsets)
        at, hashes = words.windows(3)
        seen = {}
        for i in range(len(offsets) - 1):
            own = [words.word(j).decode() for j in range(words.first[i], words.first[i + 1])]
            assert own == WORD.findall(fold(texts[row + i]))
        for i, h in zip(at.tolist(), hashes.tolist()):
            assert seen.setdefault(h, words.phrase(i, 3)) == words.phrase(i, 3)
        assert len(at) == sum(max(0, int(n) - 2) for n in words.counts())


def test_ids_are_those_of_the_tokenizer():
    texts = odd_texts(1500) + ["<|endoftext|> x<|endoftext|>y", "<|ENDOFTEXT|>", "a<b", "ÀÉ!!x--y"]
    encoder = packing.Encoder(tokenizer_path())
    for _ in range(2):  # the second time from memory
        for text, ids in zip(texts, encoder.encode(pa.array(texts, pa.string()))):
            assert ids.tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_cuts_and_combinations():
    for n in (1, 63, 64, 65, 4095, 4096, 4097, 8192, 10_000):
        cuts = packing.cuts_of(n)
        assert cuts[0] == 0 and cuts[-1] == n and all(0 < b - a <= 4096 for a, b in zip(cuts, cuts[1:]))
    ways = packing.combinations(8)
    assert all(sum(k * t for k, t in w.items()) == 8 and len(w) <= 3 for w in ways)
    assert len({tuple(sorted(w.items())) for w in ways}) == len(ways)


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((6, 15)), rng.normal(size=6)
        x = packing.nnls(a, b)
        pull = a.T @ (b - a @ x)
        assert (x >= 0).all() and pull.max() < 1e-6 and np.abs(pull[x > 0]).max(initial=0) < 1e-6


@pytest.mark.parametrize("histogram", [{}, {4096: 3}, {64: 1}, {4032: 7, 3: 5}, {128: 1000, 192: 999, 2048: 77, 63: 500, 1: 3, 4096: 2}])
def test_plan_places_every_piece_once(histogram):
    covered, cells = Counter(), set()
    for length, first, end, sequence, times, offset in packing.plan(histogram):
        assert first == covered[length]
        covered[length] = end
        for i in range(end - first):
            start = offset + i % times * length
            for cell in range(start, start + length):
                assert cell < 4096 and (sequence + i // times, cell) not in cells
                cells.add((sequence + i // times, cell))
    assert {k: n for k, n in covered.items() if n} == histogram


def test_pack(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "don't", "x!!"]) for _ in range(rng.choice([0, 3, 40, 700, 5000]))) for _ in range(80)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(7, texts[7], 1), (None, "a b", 0), (200, None, 0), (201, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    got = packing.pack(docs, tokenizer_path(), with_ids=True).collect()
    encoder = packing.Encoder(tokenizer_path())
    whole = Counter((i, tuple(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t, _ in rows)
    by_doc = {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault((r.id, r.doc_tokens), []).append(r)
    for (i, n), pieces in by_doc.items():
        copies = sum(c for (d, ids), c in whole.items() if d == i and len(ids) == n)
        pieces.sort(key=lambda r: r.start)
        assert sum(r.length for r in pieces) == n * copies
        ids = sum((r.ids for r in pieces[::copies]), [])
        assert whole[(i, tuple(ids))] == copies
    assert len(by_doc) == len({(i, len(x)) for i, x in whole})
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) * 4096 <= 1.2 * sum(r.length for r in got) + 4096
    assert packing.pack(docs.where(F.lit(False)), tokenizer_path()).count() == 0


def test_encoding_holds_little_memory():
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(rng.choices(letters, k=8)) for _ in range(1000)) for _ in range(400)]
    encoder = packing.Encoder(tokenizer_path())
    tracemalloc.start()
    try:
        for _ in encoder.encode(pa.array(texts)):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(encoder.slots) <= 200_000
    assert peak < 100e6


def test_a_worker_keeps_one_model():
    first = packing.encoder_of(tokenizer_path(), 2)
    assert packing.encoder_of(tokenizer_path(), 2) is first
    gone = weakref.ref(first)
    del first
    toxicity._lexicon_of(types.SimpleNamespace(value=({"word": 1.0}, {})))
    assert gone() is None

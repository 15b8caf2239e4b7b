import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesselle.llm import packing, pieces

from .data import documents, frame, odd_columns

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
FULL = Tokenizer.from_file(VOCABULARY)  # as it comes

ODD = st.text(st.one_of(st.sampled_from(" \t\n▁ 　<s>ab'é中\x00"), st.characters(codec="utf-8")), max_size=60)
SPECIAL = st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "a", "  b", "\n", "é"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=5))
def test_pieces_are_those_of_the_library(texts):
    for text, (ids, decoded) in zip(texts, pieces.chunk_table(MODEL).encode(texts)):
        want = SP.encode(text)
        assert ids == ",".join(map(str, want)) and decoded == SP.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(ODD, SPECIAL), min_size=1, max_size=5))
def test_byte_pairs_are_those_of_the_library(texts):
    table = packing.word_table(VOCABULARY, RANKS, public_tokenizers.PATTERN)
    for text, ids in zip(texts, table.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == FULL.encode(text, add_special_tokens=False).ids


def test_small_tables_change_nothing():
    texts = [t or "" for _, t, *_ in documents(20)] + ["one two  three", "<|endoftext|> two\nthree "]
    small, large = pieces.ChunkTable(MODEL, limit=500), pieces.ChunkTable(MODEL)
    few, many = packing.WordTable(VOCABULARY, RANKS, public_tokenizers.PATTERN, limit=500), packing.WordTable(VOCABULARY, None, None)
    for t in texts:
        assert list(small.encode([t])) == list(large.encode([t]))
        assert list(few.encode([t])) == list(many.encode([t]))


def test_tables_are_bounded_in_bytes():
    r = random.Random(3)
    chunks, words = pieces.ChunkTable(MODEL, limit=1 << 20), packing.WordTable(VOCABULARY, RANKS, public_tokenizers.PATTERN, limit=1 << 20)
    for i in range(60):
        text = " ".join("".join(r.choice("abcdefgh") for _ in range(r.choice([5, 200, 5000]))) for _ in range(40))
        assert list(chunks.encode([text]))[0][0] == ",".join(map(str, SP.encode(text)))
        assert np.frombuffer(next(iter(words.encode([text]))), "<u4").tolist() == FULL.encode(text, add_special_tokens=False).ids
        for table in (chunks, words):
            assert sum(len(k) + len(v) for half in (table.ids, table.older) for k, v in half.items()) < 4 << 20


def test_a_megabyte_without_a_space():
    r = random.Random(4)
    text = "".join(r.choice("abcdefghij中é") for _ in range(300_000))
    ids, decoded = next(iter(pieces.chunk_table(MODEL).encode([text])))
    assert ids == ",".join(map(str, SP.encode(text))) and decoded == text
    got = next(iter(packing.word_table(VOCABULARY, RANKS, public_tokenizers.PATTERN).encode([text])))
    assert np.frombuffer(got, "<u4").tolist() == FULL.encode(text, add_special_tokens=False).ids


def test_encode_digests(spark):
    rows = documents(21)
    got = pieces.encode_digests(odd_columns(frame(spark, rows)), MODEL).collect()
    want = []
    for d, t, *_ in rows:
        ids = SP.encode(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(SP.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    real = pieces.encode_decode(frame(spark, [(1, "ab c", None, None, 0)]), MODEL).first()
    assert list(real.ids) == SP.encode("ab c") and real.decoded == "ab c"
    assert pieces.encode_digests(frame(spark, []), MODEL).collect() == []


@pytest.mark.parametrize("length", [packing.LENGTH, 64])
def test_packing_is_whole_and_gapless(spark, length):
    rows = documents(22, n=100, longest=150)
    got = packing.pack_documents(odd_columns(frame(spark, rows).repartition(6)), VOCABULARY, RANKS, public_tokenizers.PATTERN, length=length).collect()
    want = Counter()
    for d, t, *_ in rows:
        ids = FULL.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) if len(ids) <= length else len(ids) % length or length
        cuts = [0, *range(first, len(ids) + 1, length)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(d, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= length
    total = sum(r.length for r in got)
    assert len(bins) <= 1.1 * total / length + 2
    assert packing.pack_documents(frame(spark, []), VOCABULARY, RANKS, public_tokenizers.PATTERN).collect() == []


def fill(counts, length):
    bins = [[length, []] for _ in range(0)]
    for size in sorted(Counter(counts).elements(), reverse=True):
        fits = [b for b in bins if b[0] >= size]
        b = min(fits, key=lambda b: b[0]) if fits else None
        if b is None:
            b = [length, []]
            bins.append(b)
        b[0] -= size
    return len(bins)


def test_plan_against_best_fit():
    r, found, best_fit = random.Random(0), 0, 0
    for trial in range(12):
        counts = Counter(r.choice([r.randint(1, 100), r.randint(30, 60)]) for _ in range(r.randint(1, 400)))
        runs = packing.plan(dict(counts), 100)
        used, bins = Counter(), Counter()
        for size, a, b, sequence, offset in runs.tolist():
            assert used[size] == a
            used[size] = b
            for k in range(b - a):
                bins[sequence + k] += size
        assert used == counts and max(bins.values()) <= 100
        best = fill(counts, 100)
        assert len(bins) <= best + 2  # a few pieces more or less; better on the whole
        found, best_fit = found + len(bins), best_fit + best
    assert found <= best_fit


def test_best_two():
    free = np.zeros(101, int)
    free[[10, 20, 30]] = (1, 2, 1)
    assert packing.best_two(free, 45, 30) == (20, 20)
    assert packing.best_two(free, 50, 30) == (30, 20)
    assert packing.best_two(free, 19, 5) is None
    assert packing.best_two(free, 30, 30) is None
    free[20] = 1
    assert packing.best_two(free, 45, 30) is None  # 10 is too short to replace 30
    assert packing.best_two(free, 45, 20) == (30, 10)

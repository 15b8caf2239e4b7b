import hashlib
import os.path
import random
from collections import Counter

import numpy as np
import pytest

from tesselle.llm import suffix

from .data import documents, frame, odd_columns


def brute(rows, stretch):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[i : i + stretch] for t in texts for i in range(len(t) - stretch + 1))
    out = []
    for (doc, *_), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - stretch + 1):
            if seen[t[i : i + stretch]] > 1:
                gone[i : i + stretch] = True
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("stretch,lead,part,buckets", [(200, 32, 1 << 20, 3), (20, 8, 64, 7), (33, 17, 100, 2)])
def test_against_brute_force(spark, stretch, lead, part, buckets):
    rows = documents(stretch, n=80)
    df = odd_columns(frame(spark, rows))
    got = suffix.removal_digests(df, stretch=stretch, lead=lead, part=part, buckets=buckets).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, stretch)


def test_random_bytes_with_periods_and_one_hot_passage(spark):
    r = random.Random(5)
    hot = "".join(r.choice("ab") for _ in range(60))
    rows = [(i, "".join(r.choice("abc") for _ in range(r.randint(0, 90))) + hot[: r.randint(20, 60)] + r.choice(["", "ab" * 30, "xyz"]), None, None, 0) for i in range(150)]
    got = suffix.removal_digests(frame(spark, rows), stretch=25, lead=10, part=50, buckets=9).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 25)


def test_empty_table_and_kept_columns(spark):
    assert suffix.removal_digests(frame(spark, [])).collect() == []
    rows = documents(1)
    df = odd_columns(frame(spark, rows))
    out = suffix.remove_repeats(df, stretch=40, lead=20)
    assert out.columns == df.columns and out.count() == len(rows)
    lengths = {d: n - g for d, n, g, _, _ in brute(rows, 40) if d is not None}
    for row in out.collect():
        assert row.n_chars == len(row.text or "")
        if row.doc_id is not None and row.doc_id not in (6, 9):
            assert len((row.text or "").encode()) <= lengths[row.doc_id]


def test_multikey_quicksort_and_buckets():
    r = np.random.default_rng(0)
    words = r.integers(0, 4, (500, 3)).astype(np.uint64)
    order = suffix.multikey_quicksort(words)
    rows = [tuple(x) for x in words.tolist()]
    assert [rows[i] for i in order] == sorted(rows) and sorted(order.tolist()) == list(range(500))
    cuts = sorted(rows)[::60]
    splitters = [np.array(c, np.uint64) for c in zip(*cuts)]
    assert suffix.bucket_of(list(words.T), splitters).tolist() == [sum(c <= row for c in cuts) for row in rows]


def test_common_prefixes():
    r = np.random.default_rng(1)
    rows = r.integers(0, 3, (300, 16)).astype(np.uint8)
    order = suffix.multikey_quicksort(suffix.as_words(rows))
    got = suffix.common_prefixes(rows, order)
    texts = [bytes(rows[i]) for i in order]
    assert texts == sorted(texts)
    assert got.tolist() == [0, *(len(os.path.commonprefix([a, b])) for a, b in zip(texts, texts[1:]))]


def test_a_lead_that_fills_buckets_is_split_and_others_are_not():
    r = np.random.default_rng(2)
    lead = np.where(r.random(4000) < 0.5, 7, r.integers(0, 1000, 4000)).astype(np.uint64)
    drawn = [lead, lead + np.uint64(1), r.integers(0, 1 << 60, 4000).astype(np.uint64), r.integers(0, 1 << 60, 4000).astype(np.uint64)]
    cuts, split = suffix.choose_splitters(drawn, 20, 2)
    assert split.tolist() == [7]
    bucket = suffix.bucket_of(drawn, cuts)
    assert np.bincount(bucket, minlength=20).max() < 500
    for one in np.unique(lead):
        assert one == 7 or len(np.unique(bucket[lead == one])) == 1


@pytest.mark.parametrize("block", [1, 2000, 1 << 24])
def test_blocks_of_any_size(spark, block):
    rows = documents(6, n=60) + [(700 + i, "xyz " * i, None, None, 0) for i in range(30)]
    got = suffix.removal_digests(frame(spark, rows), stretch=24, lead=8, part=200, buckets=5, block=block).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 24)


def test_cells(spark, monkeypatch):
    monkeypatch.setattr(suffix, "MAX_BUCKETS", 2)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 4000)
    rows = documents(8, n=60)
    assert suffix.draw_splitters(frame(spark, rows).selectExpr("1L k0", "1L k1", "text"), 30_000, 24, 8, 200, None)[1:] == (2, 13)
    got = suffix.removal_digests(frame(spark, rows), stretch=24, lead=8, part=200).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 24)


def test_very_long_texts_without_spaces(spark):
    r = random.Random(9)
    noise = "".join(r.choice("abcdef") for _ in range(400_000))
    rows = [(1, "a" * 1_000_000, None, None, 0), (2, "ab" * 300_000, None, None, 0), (3, noise, None, None, 0), (4, "q" + noise[1000:300_000], None, None, 0)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in suffix.removal_digests(frame(spark, rows)).collect()}
    assert got == {1: (1_000_000, 1_000_000, 1), 2: (600_000, 600_000, 1), 3: (400_000, 299_000, 1), 4: (299_001, 299_000, 1)}

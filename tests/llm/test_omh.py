import hashlib
import random

import numpy as np

from tesselle.llm import omh

from .data import documents, frame, odd_columns, row_key


def one_signature(text, k=omh.K):
    """Sketch by sketch, from single k-mers."""
    grams = [text[i : i + k] for i in range(len(text) - k + 1)] if len(text) >= k else [text] * bool(text)
    seen, sketches = {}, [[] for _ in range(omh.SKETCHES)]
    for at, gram in enumerate(grams):
        number = seen.get(gram, 0)
        seen[gram] = number + 1
        h = omh.kmers(np.array([ord(c) for c in gram], np.uint32), len(gram))[:1]
        priority = int(omh._mixed(h + np.uint64(number) * omh.ODD2)[0])
        item = int(omh._mixed(h + np.uint64(number) * omh.ODD1)[0])
        sketches[priority >> (64 - omh.SKETCH_BITS)].append((priority, at, item))
    out = []
    for i, s in enumerate(sketches):
        chosen = sorted(s)[:2]
        for n in range(1, omh.SKETCHES):
            other = sketches[(i + n * int(omh.STEPS[i])) % omh.SKETCHES]
            if len(chosen) < 2 and other:
                chosen.append(min(other))
        if not chosen:
            out.append(0)
            continue
        chosen.sort(key=lambda x: x[1])
        total = sum(item * (2 * n + int(omh.ODD1)) for n, (_, _, item) in enumerate(chosen)) % (1 << 64)
        out.append(1 + int(omh._mixed(np.array([total], np.uint64))[0]) % 65535)
    return out


def test_signatures_against_single_kmers():
    r = random.Random(0)
    texts = ["", "a", "short", "abcdefgh", "ab" * 200, "x" * 300] + ["".join(r.choice("abcé中 ") for _ in range(r.randint(0, 900))) for _ in range(12)]
    got = omh.signatures(texts)
    assert [list(map(int, g)) for g in got] == [one_signature(t) for t in texts]
    shuffled = texts[::-1]
    assert (omh.signatures(shuffled)[::-1] == got).all()


def test_parts_do_not_matter(monkeypatch):
    texts = [t or "" for _, t, *_ in documents(2)]
    whole = omh.signatures(texts)
    monkeypatch.setattr(omh, "PART", 50)
    assert (omh.signatures(texts) == whole).all()


def test_moved_text_is_less_alike_than_the_same_text():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    a, b = " ".join(words), " ".join(words[1500:] + words[:1500])
    near = omh.likeness(omh.signatures([a]), omh.signatures([b]))[0]
    kept = omh.likeness(omh.signatures([a]), omh.signatures([a.replace(words[5], "zz")]))[0]
    assert near < 0.75 and kept > 0.95


def test_moved_passages_of_short_texts_are_seen():
    r = random.Random(4)
    near, plain = [], []
    for _ in range(40):
        words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(20)]
        a, b = " ".join(words), " ".join(words[10:] + words[:10])
        near.append(omh.likeness(omh.signatures([a]), omh.signatures([b]))[0])
        grams = [{t[i : i + omh.K] for i in range(len(t) - omh.K + 1)} for t in (a, b)]
        plain.append(len(grams[0] & grams[1]) / len(grams[0] | grams[1]))
    assert np.mean(plain) > 0.75 and np.mean(near) < 0.6
    text = "some words of a text that is short"
    assert omh.likeness(omh.signatures([text]), omh.signatures([text + "!"]))[0] > 0.6
    assert omh.likeness(omh.signatures(["abc"]), omh.signatures(["abc"]))[0] == 1 and omh.likeness(omh.signatures(["abc"]), omh.signatures(["abd"]))[0] < 0.05


def test_neighbours(spark):
    rows = documents(7)
    got = omh.neighbour_fingerprints(odd_columns(frame(spark, rows).repartition(5))).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, row_key(x[0], x[1])))
    want = []
    for i, row in enumerate(order):
        text, following = row[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + following[:half]
        s = omh.signatures([text, edit, following])
        want.append((row[0], len(text), hashlib.sha256(edit.encode()).hexdigest(), omh.packed(s)[0].hex(), omh.packed(s)[1].hex(), omh.likeness(s[:1], s[1:2])[0], omh.likeness(s[:1], s[2:])[0]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_one_document_and_none(spark):
    row = omh.neighbour_fingerprints(frame(spark, [(1, "abcd", None, None, 0)])).collect()[0]
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1.0
    assert omh.neighbour_fingerprints(frame(spark, [])).collect() == []

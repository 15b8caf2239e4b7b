import random
import re

import numpy as np
import pytest
import xxhash

from tesselle.llm import graph, simhash

from .data import documents, frame, odd_columns, row_key


def fingerprint(text, words=3):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    found = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, threshold=3):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = sorted(parent)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if bin(a ^ b).count("1") <= threshold:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("crowd", [simhash.CROWD, 3])
def test_against_all_pairs(spark, crowd):
    rows = documents(4, n=120)
    rows += [(1000 + i, rows[i % 50][1].replace("lorem", "loren", 1) if rows[i % 50][1] else "q", None, None, 0) for i in range(60)]
    got = simhash.near_groups(odd_columns(frame(spark, rows)), crowd=crowd).collect()
    fps = {i: fingerprint(r[1]) for i, r in enumerate(rows)}
    root = groups(set(fps.values()))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[fps[i]]] = min(r[0], least.get(root[fps[i]], 1 << 60))
    want = [(r[0], f"{fps[i]:016x}", least.get(root[fps[i]])) for i, r in enumerate(rows)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_links_of_close_random_fingerprints(spark):
    r = np.random.default_rng(2)
    centres = r.integers(0, 2**64, 40, dtype=np.uint64)
    fps = []
    for c in centres:
        for _ in range(25):
            x = c
            for _ in range(r.integers(0, 5)):
                x ^= np.uint64(1) << np.uint64(r.integers(0, 64))
            fps.append(int(x))
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, 0) for f in fps], "fp long, low long")
    want = groups(fps)
    for crowd in (simhash.CROWD, 50):
        edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(nodes, crowd=crowd).collect()]
        parent = {f: f for f in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[find(a)] = find(b)
        assert len({find(f) for f in fps}) == len(set(want.values()))
        assert all(want[a] == want[b] for a, b in edges)


def test_crowded_group_finds_what_pairs_find():
    r = np.random.default_rng(3)
    fps = np.unique(r.integers(0, 2**64, 3, dtype=np.uint64)[r.integers(0, 3, 3000)] ^ (np.uint64(1) << r.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 3000).astype(np.uint64)))
    linker = simhash.Linker(3)
    linker.crowd(fps, fps)
    u, v = linker.edges().columns
    want = groups([int(f) for f in fps])
    parent = {int(f): int(f) for f in fps}
    for a, b in zip(u.to_numpy().view(np.uint64).tolist(), v.to_numpy().view(np.uint64).tolist()):
        parent[a] = b
    assert len({parent[int(f)] for f in fps}) == len(set(want.values()))


def test_every_close_pair_meets_at_a_home():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**64, 500, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64)
    code = simhash.code(3)
    row, anchor, excess = code.anchors(a)
    home = dict(zip(row[excess == 0].tolist(), anchor[excess == 0].tolist()))
    assert len(home) == (excess == 0).sum() == 500
    row, anchor, _ = code.anchors(b)
    visits = set(zip(row.tolist(), anchor.tolist()))
    assert all((i, home[i]) in visits for i in range(500))


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(400, 400 + i) for i in range(1, 200)] + [(700 + i, 701 + i) for i in range(90)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    assert set(got) == set(parent)
    assert len({(got[x], find(x)) for x in parent}) == len(set(got.values())) == len({find(x) for x in parent})
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_one_of_each_group_stays(spark):
    rows = documents(4, n=60)
    df = odd_columns(frame(spark, rows))
    out = simhash.keep_one(df)
    found = simhash.grouped(df).collect()
    assert out.columns == df.columns
    first = {}
    for r in found:
        place = (r.doc_id is None, r.doc_id or 0, r.k0, r.k1)
        first[r.root] = min(first.get(r.root, place), place)
    left = [(r.doc_id is None, r.doc_id or 0, *row_key(r.doc_id, r.text)) for r in out.collect()]
    assert sorted(left) == sorted(first.values())
    assert simhash.near_groups(frame(spark, [])).collect() == []
    # Rows that share an id are told apart: the second one is alone in its group.
    three = [(5, "one and the same text", None, None, 0), (7, "one and the same text", None, None, 0), (7, "something else that has company nowhere", None, None, 0)]
    assert sorted((r.doc_id, r.text[:3]) for r in simhash.keep_one(frame(spark, three)).collect()) == [(5, "one"), (7, "som")]

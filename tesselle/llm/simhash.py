"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has a bit where over half of the XXH64 hashes of the text's word shingles have it.
The anchors are the words of a product code: a perfect Golay block of 23 bits (radius 3), five
perfect repetition blocks of 7 bits (radius 3 each), and 6 bits at zero (radius 6). Each
fingerprint has one home anchor, within the radius in every block. It is replicated to every
anchor within that radius plus the threshold, counted block by block: if two fingerprints differ
in e_b bits of block b, the one lies within ``radius_b + e_b`` of the other's home, and the e_b
add up to the threshold at most. At each anchor the homes are compared with all that came.

Distinct fingerprints are compared, so copies meet in an aggregate and not in pairs. Where a
sample says that an anchor gets very many fingerprints its visitors are dealt to several tasks,
to each of which its homes go; the sample sets the balance and not the result. A task reduces the links it finds to
stars, and their components are found by contraction.

Defined cases: a null or empty text, or one of white space, has fingerprint zero, which is
linked like any other. Rows with equal texts share a component, also where they share ids. A
component whose rows all have a null doc_id has the null id. Texts are hashed a shingle at a time in
runs of about 2 MB; a longer text alone, with 8 bytes for each of its shingles. An empty table gives
an empty result; other columns are kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTable, arrow_map, one_of_each, row_key, sliced, text_buffers
from .graph import components, local_stars

WORDS = 3
SEED = 42
THRESHOLD = 3
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

GOLAY_BITS, GOLAY_RADIUS = 23, 3
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GOLAY = 0b110001110101
REPEAT_BITS, REPEAT_RADIUS, REPEATS = 7, 3, 5

#: Visitors of an anchor that one task is to compare, about.
CROWD = 200_000
#: One in so many fingerprints tells how many come to an anchor.
SAMPLED = 64


# --- fingerprints

def fingerprints(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """Fingerprints of texts in UTF-8."""
    import xxhash

    digest, hashes, counts = xxhash.xxh64_intdigest, [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = text.translate(LOWER).split()  # at the bytes 20 and 09 to 0D
        n = len(found)
        if not n:
            continue
        joined = b" ".join(found)
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        k = min(words, n)
        hashes.append(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64))
        counts[i] = n - k + 1
    out = np.zeros(len(texts), np.uint64)
    if hashes:
        out[counts > 0] = majority(np.concatenate(hashes), counts[counts > 0])
    return out


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes the bits that over half of them have.

    Bits are added in byte lanes, 255 hashes at a time, eight bits of each hash in one sum.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    blocks = (counts + 254) // 255
    first = np.cumsum(blocks) - blocks
    cuts = np.repeat(starts, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    out, ones = np.zeros(len(counts), np.uint64), np.uint64(0x0101010101010101)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & ones, cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        sums = np.add.reduceat(lanes, first, axis=0)
        for byte in range(8):
            out |= (2 * sums[:, byte] > counts).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, k0 and k1 (the row's key) and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                data, ends = text_buffers(part.column(1))
                blob = data.tobytes()
                found = fingerprints([blob[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())], words)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(found.view(np.int64))], names=["doc_id", "k0", "k1", "fp"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), *row_key(id_col, text))
    return arrow_map(narrow, run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, k0 long, k1 long, fp long")


# --- the code

def syndromes(x: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the Golay polynomial."""
    x = x.astype(np.int64)
    for bit in range(GOLAY_BITS - 1, 10, -1):
        x = np.where((x >> bit) & 1, x ^ (GOLAY << (bit - 11)), x)
    return x


def golay_table(threshold: int) -> list[list[np.ndarray]]:
    """By excess over the radius and by syndrome: the error patterns that lead to a code word."""
    patterns = [sum(1 << b for b in c) for w in range(GOLAY_RADIUS + threshold + 1) for c in combinations(range(GOLAY_BITS), w)]
    patterns = np.array(patterns, np.int64)
    weight, at = np.bitwise_count(patterns).astype(int), syndromes(patterns)
    excess = np.maximum(weight - GOLAY_RADIUS, 0)
    return [[patterns[(at == s) & (excess == e)] for s in range(1 << 11)] for e in range(threshold + 1)]


class Code:
    """Anchors of fingerprints, by excess over the covering radius."""

    def __init__(self, threshold: int = THRESHOLD):
        self.threshold = threshold
        self.golay = []  # by excess: (pattern table with padding, number by syndrome)
        for rows in golay_table(threshold):
            counts = np.array([len(r) for r in rows])
            padded = np.zeros((len(rows), counts.max()), np.int64)
            for s, r in enumerate(rows):
                padded[s, : len(r)] = r
            self.golay.append((padded, counts))
        n = 1 << (REPEATS * REPEAT_BITS)
        assert n < 1 << 40
        flips = [f for k in range(threshold + 1) for f in combinations(range(REPEATS), k)]
        self.flips = np.array([sum(1 << b for b in f) for f in flips], np.int64)
        self.flipped = np.array([[b in f for b in range(REPEATS)] for f in flips], np.int64)

    def anchors(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, excess) of every anchor within the radius plus the threshold."""
        word = (fp & np.uint64((1 << GOLAY_BITS) - 1)).astype(np.int64)
        rest = (fp >> np.uint64(GOLAY_BITS)).astype(np.int64)
        ones = np.stack([np.bitwise_count((rest >> (REPEAT_BITS * b)) & 127).astype(np.int64) for b in range(REPEATS)], axis=1)
        near = (ones > REPEAT_RADIUS).astype(np.int64)  # the nearer of all zeros and all ones
        home = (near << np.arange(REPEATS)).sum(axis=1)
        cost = np.where(near == 1, ones, REPEAT_BITS - ones) - REPEAT_RADIUS  # of the other one
        costs = cost @ self.flipped.T
        syndrome = syndromes(word)
        rows, anchors, excesses = [], [], []
        for e, (patterns, counts) in enumerate(self.golay):
            r, f = np.nonzero(costs <= self.threshold - e)
            n = counts[syndrome[r]]
            row = np.repeat(r, n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            golay = word[row] ^ patterns[syndrome[row], k]
            tail = np.repeat(home[r] ^ self.flips[f], n)
            rows.append(row)
            anchors.append((golay << REPEATS) | tail)
            excesses.append(np.repeat(costs[r, f] + e, n))
        return np.concatenate(rows), np.concatenate(anchors), np.concatenate(excesses)


_codes: dict[int, Code] = {}


def code(threshold: int) -> Code:
    if threshold not in _codes:
        _codes[threshold] = Code(threshold)
    return _codes[threshold]


# --- links

HOME, HOME_ONLY, VISITOR = 1, 0, 2


def replicate(nodes: DataFrame, threshold: int, crowds: dict[int, int]) -> DataFrame:
    """anchor, salt, role, fp: each fingerprint at its home and at every anchor that it visits.

    A crowded anchor has several salts: visitors take the one of their hash, homes go to all.
    """
    crowded = np.array(sorted(crowds), np.int64)
    ways = np.array([crowds[a] for a in sorted(crowds)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                fp = batch.column(0).slice(start, 1000).to_numpy().view(np.uint64)
                row, anchor, excess = code(threshold).anchors(fp)
                home = excess == 0
                n = np.ones(len(row), np.int64)
                if len(crowded):
                    at = np.minimum(np.searchsorted(crowded, anchor), len(crowded) - 1)
                    n = np.where(crowded[at] == anchor, ways[at], 1)
                own = ((fp[row] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n
                again = np.repeat(np.arange(len(row)), np.where(home, n, 1))
                first = np.cumsum(np.where(home, n, 1)) - np.where(home, n, 1)
                salt = np.where(home[again], np.arange(len(again)) - first[again], own[again])
                role = np.where(home[again], np.where(salt == own[again], HOME, HOME_ONLY), VISITOR)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((anchor[again] << 16 | salt)), pa.array(role.astype(np.int8)), pa.array(fp[row[again]].view(np.int64))],
                    names=["anchor", "role", "fp"],
                )

    return arrow_map(nodes.select("fp"), run, "anchor long, role byte, fp long")


class Linker:
    """Compares what meets at anchors, keeps links as stars."""

    def __init__(self, threshold: int):
        self.threshold, self.u, self.v, self.held = threshold, [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.u.append(a)
        self.v.append(b)
        self.held += len(a)
        if self.held > 400_000:
            self.shrink()

    def shrink(self) -> None:
        if self.held:
            u, v = local_stars(np.concatenate(self.u), np.concatenate(self.v))
            self.u, self.v, self.held = [u], [v], 0

    def groups(self, anchor: np.ndarray, role: np.ndarray, fp: np.ndarray) -> None:
        """Whole groups, sorted by anchor and role, so that homes come first."""
        starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(anchor)]]))
        homes = np.add.reduceat((role != VISITOR).astype(np.int64), starts)
        big = homes * sizes > 4_000_000
        for g in np.flatnonzero(big):
            s = slice(starts[g], starts[g] + sizes[g])
            self.crowd(fp[s][: homes[g]], fp[s][role[s] != HOME_ONLY])
        rows = np.flatnonzero((role != HOME_ONLY) & ~np.repeat(big, sizes))
        group = np.repeat(np.arange(len(starts)), sizes)[rows]
        n = homes[group]
        at = 0
        while at < len(rows):  # about a million pairs at a time
            stop = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), 1_000_000)) + at)
            r, k = rows[at:stop], n[at:stop]
            mine = np.repeat(r, k)
            other = np.arange(len(mine)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(starts[group[at:stop]], k)
            a, b = fp[mine], fp[other]
            hit = (np.bitwise_count(a ^ b) <= self.threshold) & (a != b)
            self.add(a[hit], b[hit])
            at = stop

    def crowd(self, homes: np.ndarray, probes: np.ndarray) -> None:
        """A large group: of threshold + 1 parts of the bits, close fingerprints share one."""
        parts = self.threshold + 1
        for p in range(parts):
            low, high = 64 * p // parts, 64 * (p + 1) // parts
            cut = lambda x: (x >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)  # noqa: B023, E731
            mine = homes[np.argsort(cut(homes), kind="stable")]
            keys = cut(mine)
            for at in range(0, len(probes), 20_000):
                some = probes[at : at + 20_000]
                first, last = np.searchsorted(keys, cut(some), "left"), np.searchsorted(keys, cut(some), "right")
                depth = 0
                while True:  # the n-th partner of all probes at once
                    on = np.flatnonzero(first + depth < last)
                    if not len(on):
                        break
                    width = max(1, min(int((last - first).max()), 1_000_000 // len(on)))
                    other = first[on][:, None] + depth + np.arange(width)[None, :]
                    inside = other < last[on][:, None]
                    b = mine[np.minimum(other, len(mine) - 1)]
                    a = np.broadcast_to(some[on][:, None], b.shape)
                    hit = inside & (np.bitwise_count(a ^ b) <= self.threshold) & (a != b)
                    self.add(a[hit], b[hit])
                    depth += width

    def edges(self) -> pa.RecordBatch:
        self.shrink()
        u, v = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (self.u, self.v))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def links(nodes: DataFrame, threshold: int = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """u, v: links between distinct fingerprints whose components are those of all links."""
    few = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0)
    counts = replicate(few, threshold, {}).groupBy("anchor").count().where(F.col("count") * SAMPLED > crowd)
    # At most (anchors of a fingerprint) * (fingerprints / crowd) rows come to the driver, each of 16 bytes.
    crowds = {r["anchor"] >> 16: min(1 << 15, -(-r["count"] * SAMPLED // crowd)) for r in counts.toLocalIterator()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker, rest = Linker(threshold), None
        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
            if len(rest[0]) and (cut := int(np.searchsorted(rest[0], rest[0][-1]))):
                linker.groups(*(x[:cut] for x in rest))
                rest = [x[cut:] for x in rest]
        if rest is not None and len(rest[0]):
            linker.groups(*rest)
        yield linker.edges()

    met = replicate(nodes, threshold, crowds).repartition("anchor").sortWithinPartitions("anchor", "role")
    return arrow_map(met, run, "u long, v long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """doc_id, k0, k1, fp, component_id and root (a fingerprint that names the component) of each row of ``docs``."""
    rows = SharedTable(fingerprint_rows(docs, id_col, text, words), "fingerprints").df
    nodes = SharedTable(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct").df
    edges = SharedTable(links(nodes, threshold, crowd), "links")
    roots = SharedTable(components(edges.df).withColumnRenamed("node", "fp"), "roots")
    known = SharedTable(nodes.join(roots.df, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "known").df
    edges.drop()
    roots.drop()
    least = known.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = SharedTable(known.join(least, "root").select("fp", "root", "component_id"), "ids").df
    return rows.join(ids, "fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of ``docs``."""
    return grouped(docs, id_col, text, **options).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group, with all columns: that of the least id, null ids last, and of the least key where
    rows share the id. Of rows that share id and text one stays."""
    rows = grouped(docs, id_col, text, **options)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k0", "k1")
    stay = rows.groupBy("root").agg(F.min(place).alias("first")).select(F.col("first.k0").alias("k0"), F.col("first.k1").alias("k1"))
    counts = rows.select("k0", "k1").join(stay.hint("merge"), ["k0", "k1"], "left_semi").groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("n"))
    counts = SharedTable(counts, "near").df
    return one_of_each(docs, counts, id_col, text)

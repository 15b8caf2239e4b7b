"""Removal of repeated byte strings by a sparse suffix array in sampled buckets.

Every byte goes that a string of 200 bytes covers which also starts anywhere else. The suffixes
that are sorted are those at anchors: of each window of 200 bytes the place whose 32 bytes have
the least hash. Equal windows have their anchors at the same place, so a window that is repeated
is found through its own anchor, whichever the texts around it. An anchor goes on its way with the
bytes of all windows that have it.

Splitters sampled from some texts deal the suffixes to buckets by their leading 8-byte tokens.
Suffixes with the same lead are in one bucket, but for a lead that fills buckets, which is split
further and settled across them. Buckets that would outgrow memory have cells, by a hash of the lead,
and arrive cell by cell. A cell, or a part of it that fits into memory, is a block. It is sorted by a three-way multikey quicksort, from the anchor on and,
within equal leads, once more from the anchor back. The common prefixes of neighbours in the two
orders tell for each distance from the anchor which windows are equal, byte for byte.

Where a lead goes on in another block or bucket, each different window of it is sent to a second
step under a 128-bit BLAKE2 digest, one for each block, and those that meet there are repeated.

Defined cases: a null text is the empty text. Each row is a text of its own, also where rows
share id and text: those repeat each other. An empty table gives an empty result. The spans are
judged on the input. A very long text is taken in parts that overlap. Strings that a period
repeats within a part are found there, and one of each goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTable, arrow_map, fresh, row_key, settle, text_buffers, whole_text

#: Bytes of a repeated string.
STRETCH = 200
#: Bytes that an anchor is chosen by.
LEAD = 32
#: Windows that are hashed at a time; a longer text is taken in parts.
PART = 1 << 18
#: One in so many texts is sampled for splitters, and so many suffixes are drawn for each bucket.
SAMPLED, OVERSAMPLE = 64, 40
#: Bytes of a bucket, about, and buckets at most: beyond that a bucket has several cells of that size.
BUCKET_BYTES, MAX_BUCKETS = 16 << 20, 20_000
#: Bytes that are sorted in memory at a time, and that a task gathers before it sends them.
BLOCK_BYTES, BUFFER_BYTES = 32 << 20, 16 << 20
#: Bits of the map of texts that have anything to remove; more texts make it fuller, never wrong.
MAP_BITS = 1 << 24
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACE = np.uint64((1 << 26) - 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, INVERSE))
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Hashes:
    """Hashes of any stretch of some bytes, by differences of running sums modulo 2^64."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def window_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values, from running minima to both sides of block ends."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, hashes: Hashes, stretch: int = STRETCH, lead: int = LEAD):
    """(anchor, text number, first window, windows) of every anchor, and of the windows known to be
    repeated (text number, first window, windows)."""
    if len(data) < stretch:
        return tuple(np.zeros(0, np.int64) for _ in range(4)), tuple(np.zeros(0, np.int64) for _ in range(3))
    leads = hashes.every(lead)
    keys = (leads & ~PLACE) | (PLACE - np.arange(len(leads), dtype=np.uint64))
    least = window_least(keys, stretch - lead + 1)  # by first byte of the window
    change = np.empty(len(least), bool)
    change[0] = True
    np.not_equal(least[1:], least[:-1], out=change[1:])
    # windows are those that lie within a text; a text's first window begins a run
    valid_lo, valid_hi = offsets[:-1], offsets[1:] - stretch
    long = valid_hi >= valid_lo
    change[valid_lo[long]] = True
    inside = np.zeros(len(least) + 1, np.int64)
    np.add.at(inside, valid_lo[long], 1)
    np.add.at(inside, valid_hi[long] + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    change[1:] |= inside[1:] != inside[:-1]
    first = np.flatnonzero(change)
    last = np.concatenate([first[1:], [len(least)]]) - 1
    ok = inside[first]
    first, n = first[ok], (last - first + 1)[ok]
    at = (PLACE - (least[first] & PLACE)).astype(np.int64)
    found = np.zeros(0, np.int64), np.zeros(0, np.int64)
    again = leads[at[1:]] == leads[at[:-1]]
    if again.any():  # neighbours with one lead: a period, perhaps
        near = np.zeros(len(at), bool)
        near[1:] |= again
        near[:-1] |= again
        (at, first, n), found = without_periods(data, hashes, at, first, n, near, stretch, valid_lo[long])
    text_of = lambda x: np.searchsorted(offsets, x, "right") - 1
    return (at, text_of(first), first, n), (text_of(found[0]), *found)


def expanded(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, n of each."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def runs_of(x: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the runs of consecutive numbers that also begin anew where ``new`` says."""
    begins = np.ones(len(x), bool)
    begins[1:] = new[1:] | (x[1:] != x[:-1] + 1)
    at = np.flatnonzero(begins)
    return x[at], np.diff(np.append(at, len(x)))


def without_periods(data, hashes, at, first, n, near, stretch, begins):
    """The anchors with one of each window that occurs twice among those ``near``, and all such windows."""
    start, owner = expanded(first[near], n[near]), np.repeat(np.flatnonzero(near), n[near])
    _, where, inverse, counts = np.unique(hashes.of(start, start + stretch), return_index=True, return_inverse=True, return_counts=True)
    twice, head = counts[inverse] > 1, where[inverse]
    view = np.lib.stride_tricks.sliding_window_view(data, stretch)
    for some in np.array_split(np.flatnonzero(twice), max(1, int(twice.sum()) // 10_000)):
        differs = (view[start[some]] != view[start[head[some]]]).any(axis=1)  # equal hashes of different bytes
        twice[np.isin(inverse, inverse[some[differs]])] = False
    keep = ~twice | (head == np.arange(len(start)))
    first_kept, n_kept = runs_of(start[keep], np.concatenate([[True], owner[keep][1:] != owner[keep][:-1]]))
    of = owner[np.searchsorted(start, first_kept)]
    found = runs_of(start[twice], np.isin(start[twice], begins))  # not over the beginning of a text
    return [np.concatenate(x) for x in ((at[~near], at[of]), (first[~near], first_kept), (n[~near], n_kept))], found


# --- suffixes at anchors

def slices(column: pa.Array, part: int = PART, stretch: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, rows, places) of runs of short texts and of parts of long ones, which overlap."""
    data, offsets = text_buffers(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + part, "right")) - 1)
        start, end = offsets[row], offsets[stop]
        if end - start <= part or stop > row + 1:
            yield data[start:end], offsets[row : stop + 1] - start, np.arange(row, stop), np.zeros(stop - row, np.int64)
        else:
            for at in range(0, int(end - start) - stretch + 1, part):
                some = data[start + at : min(end, start + at + part + stretch - 1)]
                yield some, np.array([0, len(some)]), np.array([row]), np.array([at], np.int64)
        row = stop


def tokens(data: np.ndarray, hashes: Hashes, at, first, n, k0, place, stretch: int, lead: int) -> list[np.ndarray]:
    """The leading 8-byte words of each suffix, and for leads that fill buckets hashes of its bytes and of its place."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    out = [words[at + 8 * i].view(">u8").ravel().astype(np.uint64) for i in range(max(1, lead // 8))]
    return [*out, hashes.of(first, first + n + stretch - 1), mixed(k0.view(np.uint64) * BASE ^ place.astype(np.uint64))]


#: A blob holds m suffixes of a bucket's cell: their arrays and bytes, compressed; ``size`` bytes before that.
BLOB = "bucket int, cell int, known boolean, m int, size int, blob binary"


class Sender:
    """Gathers suffixes until they have BUFFER_BYTES, then makes a blob for each cell, in the order of the first tokens."""

    def __init__(self, cuts: list[np.ndarray], cells: int, lead_words: int, stretch: int):
        self.cuts, self.cells, self.lead_words, self.stretch = cuts, cells, lead_words, stretch
        self.clear()

    def clear(self) -> None:
        self.rows, self.known, self.data, self.size, self.held = [], [], [], 0, 0

    def add(self, data, k0, k1, lo, n, back, first, tokens) -> None:
        bucket = bucket_of(tokens, self.cuts)
        cell = np.zeros(len(lo), np.int64)
        if self.cells > 1:
            h = tokens[0]
            for t in tokens[1 : self.lead_words]:
                h = mixed(h * BASE + t)
            cell = (mixed(h) % np.uint64(self.cells)).astype(np.int64)
        self.rows.append((k0, k1, lo, n, back, first + self.size, bucket, cell, tokens[0], tokens[min(1, self.lead_words - 1)]))
        self.data.append(data)
        self.size += len(data)
        self.held += int((n + self.stretch - 1).sum())

    def flush(self) -> Iterator[pa.RecordBatch]:
        out = []
        if self.known:
            k0, k1, lo, n = (np.concatenate(x) for x in zip(*self.known))
            if len(k0):
                out.append((int(k0[0] % (len(self.cuts[0]) + 1)), 0, True, len(k0), [k0, k1, lo, n.astype(np.int32)]))
        if self.rows:
            k0, k1, lo, n, back, start, bucket, cell, w0, w1 = (np.concatenate(x) for x in zip(*self.rows))
            order = np.lexsort([w1, w0, cell, bucket])
            k0, k1, lo, n, back, start, bucket, cell = (x[order] for x in (k0, k1, lo, n, back, start, bucket, cell))
            length, data = n + self.stretch - 1, np.concatenate(self.data)
            cuts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1]), [True]]))
            for a, z in zip(cuts, cuts[1:]):
                out.append((bucket[a], cell[a], False, z - a, [k0[a:z], k1[a:z], lo[a:z], n[a:z].astype(np.int32), back[a:z].astype(np.int32)], data, start[a:z], length[a:z]))
        self.clear()
        for k in range(0, len(out), 100):
            some, sizes, blobs = out[k : k + 100], [], []
            for _, _, _, _, arrays, *places in some:
                raw = b"".join([x.tobytes() for x in arrays] + [d[expanded(start, length)].tobytes() for d, start, length in ([places] if places else [])])
                sizes.append(len(raw))
                blobs.append(pa.compress(raw, "zstd", asbytes=True))
            columns = [pa.array([o[i] for o in some], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.bool_(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], names=[f.split(" ")[0] for f in BLOB.split(", ")])


def opened(m: int, size: int, blob, kinds: tuple) -> list[np.ndarray]:
    """The arrays of a blob, and the bytes behind them."""
    raw, at, out = pa.decompress(blob, size, "zstd"), 0, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, m, at))
        at += out[-1].nbytes
    return [*out, np.frombuffer(raw, np.uint8, size - at, at)]


KNOWN = (np.int64, np.int64, np.int64, np.int32)
SUFFIXES = (*KNOWN, np.int32)


def suffixes(texts: DataFrame, splitters: Broadcast, cells: int = 1, stretch: int = STRETCH, lead: int = LEAD, part: int = PART, buffer: int = BUFFER_BYTES) -> DataFrame:
    """The anchors of (k0, k1, text) as BLOB rows; of each: key, first window, number of windows, distance
    from the first window's start to the anchor, bytes. Windows known to be repeated go without the last two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(splitters.value[0], cells, max(1, lead // 8), stretch)
        for batch in batches:
            k0, k1 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for data, offsets, rows, places in slices(batch.column(2), part, stretch):
                hashes = Hashes(data)
                (at, text, first, n), (f_text, f_first, f_n) = anchors(data, offsets, hashes, stretch, lead)
                if not len(at):
                    continue
                row, low = rows[text], first - offsets[text] + places[text]
                sender.add(data.copy(), k0[row], k1[row], low, n, at - first, first, tokens(data, hashes, at, first, n, k0[row], low, stretch, lead))
                row = rows[f_text]
                sender.known.append((k0[row], k1[row], f_first - offsets[f_text] + places[f_text], f_n))
                if sender.held >= buffer:
                    yield from sender.flush()
        yield from sender.flush()

    return arrow_map(texts, run, BLOB)


# --- splitters

def bucket_of(rows: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """The number of splitters that are not above each row, comparing token by token."""
    low, high = np.searchsorted(splitters[0], rows[0], "left"), np.searchsorted(splitters[0], rows[0], "right")
    if len(rows) == 1:
        return high
    out = low.copy()
    unsure = np.flatnonzero(high > low)
    for first in np.unique(low[unsure]):  # a leading token that is itself a splitter
        some = unsure[low[unsure] == first]
        last = high[some[0]]
        out[some] = first + bucket_of([t[some] for t in rows[1:]], [s[first:last] for s in splitters[1:]])
    return out


def choose_splitters(drawn: list[np.ndarray], buckets: int, lead_words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(splitters, first tokens of leads that are split): quantiles of the drawn rows.

    A lead that is one splitter's only is not split: its other tokens are set to the least.
    """
    m = len(drawn[0])
    order = multikey_quicksort(np.stack(drawn, axis=1)) if m else np.zeros(0, np.int64)
    at = order[np.unique((np.arange(1, buckets) * m) // buckets)] if m else order
    cuts = [t[at] for t in drawn]
    same = np.ones(max(0, len(at) - 1), bool)
    for t in cuts[:lead_words]:
        same &= t[1:] == t[:-1]
    split = np.zeros(len(at), bool)
    split[1:] |= same
    split[:-1] |= same
    for t in cuts[lead_words:]:
        t[~split] = 0
    return cuts, np.unique(cuts[0][split])


def draw_splitters(texts: DataFrame, total: int, stretch: int, lead: int, part: int, buckets: int | None) -> tuple[Broadcast, int, int]:
    """Splitters, the number of buckets, and of cells in each, for ``total`` bytes of text. The driver gets
    about OVERSAMPLE rows for each bucket, of MAX_BUCKETS at most."""
    per_anchor = (stretch - lead + 2) / 2  # windows, in the mean over random bytes
    wanted = max(1, int(total * (per_anchor + stretch - 1) / per_anchor / BUCKET_BYTES))
    cells = -(-wanted // MAX_BUCKETS)
    buckets = buckets or min(wanted, MAX_BUCKETS)
    words = max(1, lead // 8)
    names = [f"t{i}" for i in range(words + 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k0 = batch.column(0).to_numpy()
            for data, offsets, rows, places in slices(batch.column(2), part, stretch):
                hashes = Hashes(data)
                (at, text, first, n), _ = anchors(data, offsets, hashes, stretch, lead)
                if len(at):
                    t = tokens(data, hashes, at, first, n, k0[rows[text]], first - offsets[text] + places[text], stretch, lead)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in t], names=names)

    drawn = [np.zeros(0, np.uint64) for _ in names]
    if buckets > 1:
        few = texts.where(F.pmod("k1", F.lit(SAMPLED)) == 0)
        share = min(1.0, OVERSAMPLE * buckets * SAMPLED * per_anchor / max(1, total))
        found = arrow_map(few, run, ", ".join(f"{n} long" for n in names)).where(F.pmod(F.xxhash64(*names), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).toArrow()
        drawn = [found.column(x).to_numpy().view(np.uint64) if found.num_rows else d for x, d in zip(names, drawn)]
    return texts.sparkSession.sparkContext.broadcast(choose_splitters(drawn, buckets, words)), buckets, cells


# --- blocks

def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of rows of 64-bit words: three-way partitions of all open segments at once.

    A segment is split at a pivot, the median of three, by the word at its depth: what is less or
    greater stays at that depth, what is equal goes on to the next word.
    """
    m, depth_end = words.shape
    order, step = np.arange(m), 0
    start, size, depth = np.zeros(1, np.int64), np.full(1, m), np.zeros(1, np.int64)
    while True:
        live = (size > 1) & (depth < depth_end)
        if not live.any():
            return order
        start, size, depth, step = start[live], size[live], depth[live], step + 1
        base = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(size)), size)
        inner = np.arange(len(segment)) - base[segment]
        rows = order[start[segment] + inner]
        word = words[rows, depth[segment]]
        a, b, c = (word[base + (size * ((step * i) % 97)) // 97] for i in (37, 61, 89))
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[segment]
        less, equal = word < pivot, word == pivot
        n_less, n_equal = np.add.reduceat(less, base, dtype=np.int64), np.add.reduceat(equal, base, dtype=np.int64)
        less_before, equal_before = np.cumsum(less) - less, np.cumsum(equal) - equal
        less_before -= less_before[base][segment]
        equal_before -= equal_before[base][segment]
        to = np.where(less, less_before, n_less[segment] + np.where(equal, equal_before, n_equal[segment] + inner - less_before - equal_before))
        order[start[segment] + to] = rows
        start = np.concatenate([start, start + n_less, start + n_less + n_equal])
        size = np.concatenate([n_less, n_equal, size - n_less - n_equal])
        depth = np.concatenate([depth, depth + 1, depth])


def byte_rows(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of ``width`` bytes from ``start`` on, forward or back, zero behind ``length``."""
    out = np.zeros((len(start), -(-width // 8) * 8), np.uint8)
    along = np.arange(width)
    for k in range(0, len(start), 8192):
        s, n = start[k : k + 8192, None], length[k : k + 8192, None]
        at = np.clip(s + step * along, 0, max(0, len(data) - 1))
        out[k : k + 8192, :width] = np.where(along < n, data[at], 0)
    return out


def as_words(rows: np.ndarray) -> np.ndarray:
    return rows.view(">u8").astype(np.uint64)


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each row in order the bytes that it shares with the one before; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for k in range(1, len(order), 8192):
        differs = rows[order[k : k + 8192]] != rows[order[k - 1 : k - 1 + len(order[k : k + 8192])]]
        out[k : k + 8192] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return out


class Block:
    """Suffixes that are compared with each other: (k0, k1, lo, n, back) and their bytes."""

    def __init__(self, blobs: list[list[np.ndarray]], stretch: int, lead: int):
        self.k0, self.k1, self.lo, n, back, self.data = (np.concatenate(x) for x in zip(*blobs))
        self.n, self.back, self.stretch, self.lead = n.astype(np.int64), back.astype(np.int64), stretch, lead
        length = self.n + stretch - 1
        self.start = np.cumsum(length) - length

    def compare(self, spread: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """Stretches that are repeated and, of leads that go on elsewhere (those that begin with a token
        in ``spread``, or all), one of each different window."""
        stretch, lead = self.stretch, self.lead
        ahead = self.n + stretch - 1 - self.back
        rows = byte_rows(self.data, self.start + self.back, ahead, stretch, 1)
        words = as_words(rows)
        order = multikey_quicksort(words)
        first_token = words[order, 0]
        del words
        prefix = common_prefixes(rows, order)
        begins = prefix < lead
        begins[0] = True
        group = np.cumsum(begins) - 1
        open_ = np.ones(len(order), bool) if spread is None else np.isin(first_token, spread)
        of = np.flatnonzero((np.bincount(group)[group] > 1) | open_)
        if not len(of):
            return
        # From here on rows are those with company, in the order from the anchor on.
        prefix, group, open_, at = np.where(begins, 0, prefix)[of], group[of], open_[of], order[of]
        del rows
        m, width = len(at), stretch - lead
        back, n, ahead = self.back[at], self.n[at], ahead[at]
        rows = byte_rows(self.data, self.start[at] + back - 1, back, width, -1)
        behind = multikey_quicksort(np.column_stack([group.astype(np.uint64), as_words(rows)]))
        suffix = common_prefixes(rows, behind)
        suffix[np.concatenate([[True], group[behind][1:] != group[behind][:-1]])] = -1
        place = np.empty(m, np.int64)
        place[behind] = np.arange(m)
        # Rows that agree in everything: all their windows are repeated, and one stands for them.
        alike = (np.cumsum(prefix < stretch) * (m + 1) + np.cumsum(suffix < width)[place]) * (stretch + 1) ** 2 + back * (stretch + 1) + ahead
        _, reps, inverse, copies = np.unique(alike, return_index=True, return_inverse=True, return_counts=True)
        whole = np.flatnonzero(copies[inverse] > 1)
        yield from self.found(at[whole], self.lo[at[whole]], n[whole])
        most_ahead = np.maximum(prefix, np.append(prefix[1:], 0))[reps]
        most_behind = np.empty(m, np.int64)
        most_behind[behind] = np.maximum(suffix, np.append(suffix[1:], -1))
        most_behind = most_behind[reps]
        back, n, opened, copied = back[reps], n[reps], open_[reps], copies > 1
        hit = np.zeros((len(reps), width + 1), bool)
        edges = []
        for d in range(width + 1):  # windows that begin d bytes before their anchor
            here = np.flatnonzero((d <= back) & (d > back - n) & (opened | ((most_ahead >= stretch - d) & (most_behind >= d))))
            if not len(here):
                continue
            own = reps[here]
            key = np.cumsum(prefix < stretch - d)[own] * (m + 1) + np.cumsum(suffix < d)[place[own]]
            by = np.argsort(key, kind="stable")
            same = key[by][1:] == key[by][:-1]
            twice = np.zeros(len(by), bool)
            twice[1:] |= same
            twice[:-1] |= same
            hit[here[by], d] = twice
            head = np.concatenate([[True], ~same])
            head &= opened[here[by]]
            if head.any():
                one = here[by[head]]
                edges.append((one, np.full(len(one), d), twice[head] | copied[one]))
        hit[copied] = False  # told above
        before, after = np.zeros_like(hit), np.zeros_like(hit)
        before[:, 1:], after[:, :-1] = hit[:, :-1], hit[:, 1:]
        who, low = np.nonzero(hit & ~before)
        high = np.nonzero(hit & ~after)[1] + 1  # runs in the same order
        rows_at = at[reps[who]]
        yield from self.found(rows_at, self.lo[rows_at] + back[who] - high + 1, high - low)
        for one, d, settled in edges:
            yield from self.edges(at[reps[one]], back[one] - d, settled)

    def found(self, rows: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(rows), 100_000):
            some = rows[k : k + 100_000]
            yield outcome(self.k0[some], self.k1[some], lo[k : k + 100_000], n[k : k + 100_000], np.full(len(some), FOUND))

    def edges(self, rows: np.ndarray, offset: np.ndarray, settled: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The windows at the offsets of the rows, by digest."""
        view = memoryview(self.data)
        for k in range(0, len(rows), 100_000):
            some, off, done = rows[k : k + 100_000], offset[k : k + 100_000], settled[k : k + 100_000]
            digests = b"".join([hashlib.blake2b(view[a : a + self.stretch], digest_size=16).digest() for a in (self.start[some] + off).tolist()])
            d0, d1 = np.frombuffer(digests, np.int64).reshape(-1, 2).T
            yield outcome(self.k0[some], self.k1[some], self.lo[some] + off, np.ones(len(some)), np.where(done, SETTLED, OPEN), d0, d1)


FOUND, OPEN, SETTLED = 1, 4, 5
OUTCOME = "k0 long, k1 long, lo long, n int, says byte, d0 long, d1 long"


def outcome(k0, k1, lo, n, says, d0=None, d1=None) -> pa.RecordBatch:
    none = np.zeros(len(k0), np.int64)
    columns = [k0, k1, lo, n.astype(np.int32), says.astype(np.int8), none if d0 is None else d0, none if d1 is None else d1]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=[f.split(" ")[0] for f in OUTCOME.split(", ")])


def compare_in_buckets(blobs: DataFrame, splitters: Broadcast, buckets: int, stretch: int = STRETCH, lead: int = LEAD, block: int = BLOCK_BYTES) -> DataFrame:
    """OUTCOME rows of all buckets; to be written at once.

    The blobs of a bucket arrive cell by cell, and a cell is a block. One that outgrows a block is
    cut into several, all of whose windows are settled across blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread, held, size, own, cut = splitters.value[1], [], 0, None, False
        for batch in batches:
            for bucket, cell, known, m, length, blob in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5)):
                if known:
                    k0, k1, lo, n, _ = opened(m, length, blob.as_buffer(), KNOWN)
                    yield outcome(k0, k1, lo, n, np.full(m, FOUND))
                    continue
                if held and own != (bucket, cell):
                    yield from Block(held, stretch, lead).compare(None if cut else spread)
                    held, size, cut = [], 0, False
                elif size + length > block and held:
                    yield from Block(held, stretch, lead).compare(None)
                    held, size, cut = [], 0, True
                own = bucket, cell
                held.append(opened(m, length, blob.as_buffer(), SUFFIXES))
                size += length
        if held:
            yield from Block(held, stretch, lead).compare(None if cut else spread)

    return arrow_map(blobs.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "cell"), run, OUTCOME)


def across(found: DataFrame) -> DataFrame:
    """k0, k1, lo, n of the windows that met an equal one in another block or bucket."""
    edge = found.where(F.col("says") >= OPEN)
    met = edge.groupBy("d0", "d1").agg(F.count(F.lit(1)).alias("met")).where("met > 1").select("d0", "d1")
    return edge.where(F.col("says") == OPEN).join(met.hint("merge"), ["d0", "d1"], "left_semi").select("k0", "k1", "lo", "n")


# --- from windows to texts

def bits_at(words: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (words[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1


class TextMap:
    """A bit for the key of each text that a table names; of fixed size, and safe to be too full."""

    def __init__(self, named: DataFrame, bits: int = MAP_BITS):
        words = named.select(F.pmod("k0", F.lit(bits)).alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("m"))
        got = words.toArrow()  # bits / 64 rows at most
        self.words = np.zeros(bits // 64, np.int64)
        self.words[got.column("w").to_numpy()] = got.column("m").to_numpy()
        self.bits, self.shared = bits, named.sparkSession.sparkContext.broadcast(self.words.view(np.uint64))

    def slot(self, key: str):
        return F.pmod(F.col(key), F.lit(self.bits))

    def select(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose key is in the map."""
        shared, (name,) = self.shared, fresh(rows, "_slot")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                named = bits_at(shared.value, batch.column(batch.num_columns - 1).to_numpy())
                yield batch.filter(pa.array(named)).drop_columns([name])

        return arrow_map(rows.withColumn(name, self.slot(key)), run, rows.schema)


def repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", stretch: int = STRETCH, lead: int = LEAD, part: int = PART, buckets: int | None = None, block: int = BLOCK_BYTES) -> DataFrame:
    """k0, k1 (the row's key), lo, n: stretches of n windows, from byte lo on, that are repeated."""
    assert 8 <= lead < stretch
    texts = docs.select(*row_key(id_col, text), whole_text(text).alias("text"))
    total = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    splitters, buckets, cells = draw_splitters(texts, total, stretch, lead, part, buckets)
    blobs = suffixes(texts, splitters, cells, stretch, lead, part, min(block, BUFFER_BYTES))
    found = SharedTable(compare_in_buckets(blobs, splitters, buckets, stretch, lead, block), "suffixes")
    settle()
    met = SharedTable(across(found.df), "across")
    return found.df.where(F.col("says") == FOUND).select("k0", "k1", "lo", "n").unionByName(met.df)


def with_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, TextMap]:
    """The rows of ``docs`` that the map names, with arrays _los and _ns of the repeated stretches, and, with
    a _slot, all rows again, of which apply_spans() leaves those that the map names out."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    keyed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own)), *row_key(id_col, text))
    names = TextMap(found)
    # A set: rows that share id and text have the same stretches, each of them once for every row.
    lists = found.groupBy("k0", "k1").agg(F.collect_set(F.struct("lo", "n")).alias("x")).select("k0", "k1", F.col("x.lo").alias("_los"), F.col("x.n").alias("_ns"))
    cut = names.select(keyed, "k0").join(lists.hint("merge"), ["k0", "k1"], "left").select(*own, F.lit(None).cast("long").alias("_slot"), "_los", "_ns")
    whole = keyed.select(*own, names.slot("k0").alias("_slot"), F.lit(None).cast("array<long>").alias("_los"), F.lit(None).cast("array<int>").alias("_ns"))
    return cut.unionByName(whole), names


def kept_bytes(data: np.ndarray, los: np.ndarray, ns: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, int]:
    """(what is left, number of maximal removed runs)."""
    step = np.zeros(len(data) + 1, np.int64)
    np.add.at(step, los, 1)
    np.add.at(step, los + ns + stretch - 1, -1)
    gone = np.cumsum(step[:-1]) > 0
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return data[~gone], spans


def apply_spans(spanned: tuple[DataFrame, TextMap], docs: DataFrame, text: str, make: Callable, schema, stretch: int = STRETCH) -> DataFrame:
    """``make(batch, kept)`` of each batch of with_spans(); kept has (bytes, n_removed, n_spans) of each row."""
    (rows, names), at = spanned, docs.columns.index(text)
    shared, docs_columns = names.shared, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column(len(docs_columns))
            if slots.null_count < batch.num_rows:
                batch = batch.filter(pa.array(~bits_at(shared.value, slots.to_numpy())))
            data, offsets = text_buffers(batch.column(at))
            los, ns = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            bounds, has = los.offsets.to_numpy(), los.is_valid().to_numpy(zero_copy_only=False)
            starts, counts = los.values.to_numpy(), ns.values.to_numpy()
            kept = []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                if has[i]:
                    left, spans = kept_bytes(own, starts[bounds[i] : bounds[i + 1]], counts[bounds[i] : bounds[i + 1]], stretch)
                    kept.append((left.tobytes(), len(own) - len(left), spans))
                else:
                    kept.append((own.tobytes(), 0, 0))
            yield make(batch, kept)

    return arrow_map(rows, run, schema)


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    found = repeated(narrow, **options)

    def make(batch: pa.RecordBatch, kept: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(k) + r for k, r, _ in kept], pa.int64()), pa.array([r for _, r, _ in kept], pa.int64()), pa.array([s for _, _, s in kept], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k, _, _ in kept], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return apply_spans(with_spans(narrow, found), narrow, "text", make, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", options.get("stretch", STRETCH))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with what is left of their texts, and n_chars, where there is such a column, to match.

    A character of which a byte was removed goes whole.
    """
    found = repeated(docs, id_col, text, **options)
    at, names = docs.columns.index(text), docs.columns

    def make(batch: pa.RecordBatch, kept: list) -> pa.RecordBatch:
        columns = list(batch.columns[: len(names)])
        columns[at] = pa.array([k.decode("utf-8", "ignore") if r else t.as_py() for (k, r, _), t in zip(kept, columns[at])], pa.string())
        return pa.RecordBatch.from_arrays(columns, names=names)

    out = apply_spans(with_spans(docs, found, id_col, text), docs, text, make, docs.schema, options.get("stretch", STRETCH))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out

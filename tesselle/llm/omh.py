"""Order MinHash fingerprints of whole texts, and of edits made from neighbours.

The k-mers of a text's code points are numbered by occurrence, so that repeats differ. Each
(k-mer, number) has a random 64-bit priority whose leading bits deal it to one of ``SKETCHES``
sketches. A sketch selects its two least priorities, puts the selected k-mers back into
text order and hashes them as a tuple: a signature of 16 bits that changes when k-mers are
replaced and also when they are moved, as edit distance does. A sketch with fewer than two, as short
texts have them, takes the least one of other sketches, in an order that is fixed for each sketch, so
that its tuple holds an order too. The likeness of two fingerprints is the share of equal signatures
among those that either has.

Documents are range-partitioned by id once, so that a task sees each next document itself; the
last document of a task meets the first one of the next task in a second, small step.

Defined cases: a null text is the empty text, whose fingerprint is all zeros and like itself
only. A text shorter than k is one k-mer. Rows with a null doc_id come first, rows that share an
id are in the order of their keys, 120 bits of a SHA-256 of id and text. A single row is its own next
document. Equal texts have equal fingerprints. Texts are worked on in runs of 400,000 code points, a
longer text alone, in memory that is in proportion to it. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTable, arrow_map, row_key, strings, whole_text

K = 8
TUPLE = 2
SKETCH_BITS = 7
SKETCHES = 1 << SKETCH_BITS
#: The n-th sketch that a sketch s borrows from is s + n * STEPS[s]; odd steps reach them all.
STEPS = (np.arange(SKETCHES) * 45 | 1) % SKETCHES
#: Code points that are worked on at a time; a longer text alone.
PART = 400_000

ODD1, ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD2
    h = (h ^ (h >> np.uint64(29))) * ODD1
    return h ^ (h >> np.uint64(32))


def kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k code points from each place on."""
    h, width = codes.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    power = int(ODD1)
    while k:  # doubles the width; takes the widths that add up to k
        if k & 1:
            if out is None:
                out, done = h, width
            else:
                n = len(codes) - done - width + 1
                out = out[:n] * np.uint64(power) + h[done : done + n]
                done += width
        k >>= 1
        if k:
            h = h[:-width] * np.uint64(power) + h[width:] if len(h) > width else h[:0]
            power = power * power % (1 << 64)
            width *= 2
    return _mixed(out)


def occurrences(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, number): an order of the k-mers and, in that order, how often each came before in its text."""
    bits = max(20, int(len(hashes)).bit_length())
    low = np.uint64((1 << bits) - 1)
    keys = np.sort((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64))
    order = (keys & low).astype(np.int64)
    top, owner = keys >> np.uint64(bits), doc[order]
    new = np.empty(len(keys), bool)
    new[:1] = True
    new[1:] = (top[1:] != top[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    return order, np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))


def signatures(texts: list[str], k: int = K) -> np.ndarray:
    """Signatures by text and sketch, 0 for an empty sketch."""
    out = np.zeros((len(texts), SKETCHES), np.uint16)
    row = 0
    while row < len(texts):
        stop, size = row, 0
        while stop < len(texts) and (stop == row or size + len(texts[stop]) <= PART) and stop - row < 4096:
            size += len(texts[stop])
            stop += 1
        _signatures(texts[row:stop], k, out[row:stop])
        row = stop
    return out


def _signatures(texts: list[str], k: int, out: np.ndarray) -> None:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    counts = np.maximum(lengths - k + 1, 0)
    doc = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(ends - lengths, counts)
    hashes = kmers(codes, k)[place] if len(doc) else np.zeros(0, np.uint64)
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(short):
        own = np.array([kmers(codes[ends[i] - lengths[i] : ends[i]], int(lengths[i]))[0] for i in short], np.uint64)
        at = np.searchsorted(doc, short)
        hashes, doc, place = np.insert(hashes, at, own), np.insert(doc, at, short), np.insert(place, at, (ends - lengths)[short])
    if not len(doc):
        return
    order, number = occurrences(hashes, doc)
    priority = _mixed(hashes[order] + number.astype(np.uint64) * ODD2)
    group = (doc[order] << SKETCH_BITS) | (priority >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    rank = (priority << np.uint64(SKETCH_BITS)) >> np.uint64(20)  # the next 44 bits
    keys = np.sort((group.astype(np.uint64) << np.uint64(44)) | rank)
    owner = (keys >> np.uint64(44)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    last = np.minimum(first + TUPLE, np.append(first[1:], len(keys))) - 1
    limit = np.zeros(len(texts) << SKETCH_BITS, np.uint64)
    limit[owner[first]] = keys[last] & np.uint64((1 << 44) - 1)
    chosen = np.flatnonzero(rank <= limit[group])
    at, group, rank = place[order[chosen]], group[chosen], rank[chosen]
    hashes, number = hashes[order[chosen]], number[chosen]
    by = np.lexsort([at, rank, group])
    nth = np.arange(len(by)) - np.searchsorted(group[by], group[by])  # equal ranks: the first in the text
    least, second = (np.full(len(texts) << SKETCH_BITS, -1) for _ in range(TUPLE))
    for n, found in enumerate((least, second)):
        found[group[by[nth == n]]] = by[nth == n]
    borrow(least, second)
    full = np.flatnonzero(least >= 0)
    a, b = least[full], second[full]
    alone = b < 0
    early = np.where(alone | (at[a] < at[b]), a, b)
    late = a + b - early
    item = _mixed(hashes + number.astype(np.uint64) * ODD1)
    tuples = _mixed(item[early] * ODD1 + np.where(alone, np.uint64(0), item[late] * (ODD1 + np.uint64(2))))
    out.reshape(-1)[full] = (1 + tuples % np.uint64(65535)).astype(np.uint16)


def borrow(least: np.ndarray, second: np.ndarray) -> None:
    """Fill sketches that lack one or both (-1) with the least of other sketches of their text, as far as there are any."""
    own, at = least.copy(), np.arange(len(least))
    sketch = at % SKETCHES
    some = np.repeat((own.reshape(-1, SKETCHES) >= 0).any(axis=1), SKETCHES)
    short = np.flatnonzero(some & (second < 0))
    for n in range(1, SKETCHES):
        if not len(short):
            break
        donor = own[at[short] - sketch[short] + (sketch[short] + n * STEPS[sketch[short]]) % SKETCHES]
        got, item = short[donor >= 0], donor[donor >= 0]
        empty = least[got] < 0
        least[got[empty]] = item[empty]
        second[got[~empty]] = item[~empty]
        short = short[second[short] < 0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row the share of equal signatures among those that either has; 1 where neither has any."""
    either = ((a != 0) | (b != 0)).sum(axis=1)
    equal = ((a == b) & (a != 0)).sum(axis=1)
    return np.where(either > 0, equal / np.maximum(either, 1), 1.0)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def packed(rows: np.ndarray) -> list[bytes]:
    """Fingerprints as bytes, the signatures one after another."""
    blob, width = rows.astype(">u2").tobytes(), 2 * SKETCHES
    return [blob[i : i + width] for i in range(0, len(blob), width)]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def result_rows(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    """The columns of NAMES for documents and their next ones."""
    edits = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    chain = all(a == b for a, b in zip(texts[1:], following)) and len(texts) > 1
    own = signatures([*texts, following[-1]] if chain else [*texts, *following])
    after = own[1:] if chain else own[len(texts) :]
    own, other = own[: len(texts)], signatures(edits)
    return [
        ids,
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).digest() for e in edits], pa.binary()),
        pa.array(packed(own), pa.binary()),
        pa.array(packed(other), pa.binary()),
        pa.array(likeness(own, other), pa.float64()),
        pa.array(likeness(own, after), pa.float64()),
    ]


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of NAMES for each row of ``docs``."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("text"), *row_key(id_col, text))
    kind = narrow.schema["doc_id"].dataType
    id_type = pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string()
    columns = f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, ids, texts, held = TaskContext.get().partitionId(), None, [], [], 0

        def loose(role: int, doc, text: str) -> pa.RecordBatch:
            nulls = [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([doc], id_type), *nulls, pa.array([part], pa.int32()), pa.array([role], pa.int32()), pa.array([text], pa.string())], names=[*NAMES, "part", "role", "text"])

        for batch in batches:
            for doc, one in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                if first is None:
                    first = (doc, one)
                ids.append(doc)
                texts.append(one)
                held += len(one)
                if len(texts) > 1 and held > PART:
                    yield done(result_rows(pa.array(ids[:-1], id_type), texts[:-1], texts[1:]), part)
                    ids, texts, held = ids[-1:], texts[-1:], len(one)
        if first is not None:
            if len(texts) > 1:
                yield done(result_rows(pa.array(ids[:-1], id_type), texts[:-1], texts[1:]), part)
            yield loose(1, *first)
            yield loose(2, ids[-1], texts[-1])

    def done(arrays: list, part: int) -> pa.RecordBatch:
        n = len(arrays[0])
        return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.string())], names=[*NAMES, "part", "role", "text"])

    ranged = narrow.repartitionByRange("doc_id", "k0", "k1").sortWithinPartitions("doc_id", "k0", "k1")
    found = SharedTable(arrow_map(ranged, run, f"{columns}, part int, role int, text string"), "order-minhash").df
    parts = sorted(r["part"] for r in found.where("role = 1").select("part").collect())  # one for each partition at most
    after = docs.sparkSession.createDataFrame([(p, q) for p, q in zip(parts, parts[1:] + parts[:1])], "part int, next int")
    heads = found.where("role = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    tails = found.where("role = 2").select("doc_id", "text", "part")
    pairs = tails.join(F.broadcast(after), "part").join(heads, "next").select("doc_id", "text", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(result_rows(one.column(0), strings(one.column(1)), strings(one.column(2))), names=NAMES)

    both = found.where("role = 0").select(NAMES).unionByName(arrow_map(pairs, close, columns))
    text_of = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return both.withColumns(text_of)

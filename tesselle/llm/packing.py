"""Best-two-fit packing of tokenised documents into sequences.

A document's ids are those of a byte-level BPE vocabulary, with an end id behind them. One that
is longer than a sequence is cut into full pieces, the first piece being the rest. Where a piece
goes depends on its length only, so the plan is made for the counts by length, of which there are
as many as a sequence has tokens, however large the corpus is: fill a bin greedily with the
longest pieces that fit, then replace the bin's smallest piece with two unpacked pieces, each at least
half as long, that fit its expanded gap more tightly. A bin's pattern is used for as many bins as the counts allow.
Tasks number their own pieces by length; offsets by task and length turn that into ranks, and a
piece's length and rank name its slot in the plan.

Distinct words are encoded once in a table that each task keeps, of bounded bytes. A text that holds
a special token's string, as ``<|endoftext|>``, is encoded whole, so that the string becomes that
token, as the library has it by default.

Defined cases: a null text is the empty text, which has the end id alone. Rows that share an id
are packed each for itself. Texts are worked on in runs of about 2 MB, a longer one alone. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedTable, arrow_map, sliced, strings

LENGTH = 2048
#: Bytes of each half of a task's table, about, and characters of the longest word that it keeps.
TABLE_BYTES, LONG = 56 << 20, 256
END_ID = 0

#: A space between two other characters: what follows begins a new word for the tokenizer.
GAP = re.compile(r"(?<=\S) (?=\S)")
NEAR = re.compile(r" \s|\s |^\s|\s$")
#: Chunks of these characters only are left to the faster of two libraries with the same vocabulary.
PLAIN = re.compile(r"[\x00-\x1b\x20-\x7e¡-ſ]*")

#: White space at a word's end, in joined words.
ENDS = re.compile(r"\s( |$)")

_tables: dict[tuple, WordTable] = {}


class WordTable:
    """Ids of distinct words, as 32-bit little-endian bytes; words are cut at single spaces."""

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str | None, limit: int = TABLE_BYTES):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(vocabulary)
        self.added = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.sizes = np.zeros(max(found.values()) + 1, np.int64)
            self.sizes[list(found.values())] = [len(x) for x in found]
            self.fast = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=found, special_tokens={})
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.ids, self.older, self.held = {}, {}, 0

    def one(self, chunk: str) -> bytes:
        if self.fast is not None and PLAIN.fullmatch(chunk):
            ids = self.fast.encode_ordinary(chunk)
        else:
            ids = self.full.encode(chunk, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def add(self, words: set[str]) -> None:
        missing, size = [], 0
        for word in words - self.ids.keys():
            size += 150 + 2 * len(word)
            found = self.older.get(word)
            if found is None:
                missing.append(word)
            else:
                self.ids[word] = found
        self.held += size
        if self.held > self.limit:  # what isn't met again goes; this batch's words stay
            self.older, self.ids, self.held = self.ids, {}, size
            for word in words:
                if (found := self.older.get(word)) is not None:
                    self.ids[word] = found
        if self.fast is not None and missing:
            slow = [] if PLAIN.fullmatch(joined := " ".join(missing)) and not ENDS.search(joined) else [w for w in missing if not PLAIN.fullmatch(w) or w[-1].isspace()]
            if slow:
                missing = list(set(missing).difference(slow))
            self.together(missing)
            missing = slow
        for word in missing:
            self.ids[word] = self.one(" " + word)

    def together(self, words: list[str]) -> None:
        """Encode words in one call. A space begins each, so no id spans two; the ids' bytes tell where a word ends."""
        if not words:
            return
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(words)), "<u4")
        reached = np.cumsum(self.sizes[ids])
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        stops = 4 * (np.searchsorted(reached, ends) + 1)
        blob, start = ids.tobytes(), 0
        for word, stop in zip(words, stops.tolist(), strict=True):
            self.ids[word] = blob[start:stop]
            start = stop

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        special = [any(a in t for a in self.added) for t in texts]
        cut = [[] if odd else GAP.split(t) if NEAR.search(t) else t.split(" ") for t, odd in zip(texts, special)]
        words = {w for found in cut for w in found[1:]}
        long = [w for w in words if len(w) > LONG]
        self.add(words.difference(long) if long else words)
        for word in long:  # known for this call only
            self.ids[word] = self.one(" " + word)
        get = self.ids.__getitem__
        try:
            for text, odd, found in zip(texts, special, cut):
                if odd:
                    yield np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                else:
                    yield b"".join([self.one(found[0]), *map(get, found[1:])]) if found[0] else b""
        finally:
            for word in long:
                del self.ids[word]


def word_table(vocabulary: str, ranks: str | None, pattern: str | None) -> WordTable:
    key = (vocabulary, ranks, pattern)
    if key not in _tables:
        _tables[key] = WordTable(*key)
    return _tables[key]


def cut_pieces(ids: bytes, length: int = LENGTH, end_id: int = END_ID) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of the pieces of a document."""
    ids += int(end_id).to_bytes(4, "little")
    n = len(ids) // 4
    first = n if n <= length else (n % length or length)
    out, start, size = [], 0, first
    while start < n:
        out.append((len(out), start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
        start, size = start + size, length
    return out


def pieces_of(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The pieces of all documents, each with its task and its number among the task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, task = word_table(vocabulary, ranks, pattern), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        table.clear()
        for batch in batches:
            for part in sliced(batch, "text"):
                source, rows = [], []
                for i, ids in enumerate(table.encode(strings(part.column(1)))):
                    got = cut_pieces(ids, length)
                    source += [i] * len(got)
                    rows += got
                cols = np.array(rows, np.int64).reshape(-1, 4).T
                number = np.zeros(len(rows), np.int64)
                order = np.argsort(cols[2], kind="stable")
                sizes, first, counts = np.unique(cols[2][order], return_index=True, return_counts=True)
                number[order] = np.arange(len(rows)) - np.repeat(first, counts) + np.repeat(seen[sizes], counts)
                seen[sizes] += counts
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(source, pa.int64())), pa.array(cols[0].astype(np.int32)), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3]), pa.array(np.full(len(rows), task, np.int32)), pa.array(number)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"],
                )
        table.clear()

    narrow = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text}` AS text")
    return arrow_map(narrow, run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, number long")


def plan(counts: dict[int, int], length: int = LENGTH) -> np.ndarray:
    """Runs of slots: rows of (length, first rank, end rank, first sequence, offset).

    Bins of one pattern are planned together, as many as the scarcest of its lengths allows, so
    each pattern uses a length up or leaves less of it than the pattern holds: the number of
    patterns grows with the lengths, not with the corpus.
    """
    left = np.zeros(length + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    used = np.zeros(length + 1, np.int64)
    runs, sequence = [], 0
    while True:
        some = np.flatnonzero(left)
        if not len(some):
            break
        bin_, taken, gap = [], np.zeros(length + 1, np.int64), length
        while gap:  # greedily, the longest that fits
            fits = some[: np.searchsorted(some, gap, "right")]
            fits = fits[left[fits] > taken[fits]]
            if not len(fits):
                break
            size = int(fits[-1])
            bin_.append(size)
            taken[size] += 1
            gap -= size
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            pair = best_two(left - taken, gap + smallest, smallest)
            if pair:
                bin_ = bin_[:-1] + list(pair)
                taken[smallest] -= 1
                for size in pair:
                    taken[size] += 1
        kinds = np.flatnonzero(taken)
        most = int((left[kinds] // taken[kinds]).min())
        offset = 0
        for size in bin_:
            runs.append((size, used[size], used[size] + most, sequence, offset))
            used[size] += most
            offset += size
        left[kinds] -= most * taken[kinds]
        sequence += most
    return np.array(runs, np.int64).reshape(-1, 5)


def best_two(free: np.ndarray, gap: int, above: int) -> tuple[int, int] | None:
    """The two free lengths with the largest sum over ``above`` and up to ``gap``; the more even ones on a tie.

    Each is at least half of ``above``, the length they replace: shorter ones are left for gaps that nothing else fits.
    """
    sizes = np.flatnonzero(free > 0)
    sizes = sizes[2 * sizes >= above]
    if not len(sizes):
        return None
    at = np.searchsorted(sizes, gap - sizes, "right") - 1  # the longest partner of each
    ok = (at >= 0) & ((sizes[at] != sizes) | (free[sizes] > 1))
    partner = np.where(ok, sizes[at], 0)
    lone = (at > 0) & ~ok  # the same length, of which there is one
    partner[lone] = sizes[at[lone] - 1]
    sums = np.where(partner > 0, sizes + partner, 0)
    best = int(sums.max())
    if best <= above:
        return None
    tied = np.flatnonzero(sums == best)
    i = tied[np.argmin(np.abs(sizes[tied] - partner[tied]))]
    a, b = int(sizes[i]), int(partner[i])
    return (max(a, b), min(a, b))


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Give each written piece its sequence and its offset there."""
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = SharedTable(counts, "counts").df
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # a row for each length at most
    runs = plan({r["length"]: r["n"] for r in totals}, length)
    order = np.lexsort([runs[:, 1], runs[:, 0]])
    runs = runs[order]
    shared = pieces.sparkSession.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        starts = np.searchsorted(runs[:, 0], np.arange(length + 2))
        for batch in batches:
            size, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.zeros(len(size), np.int64)
            for s in np.unique(size):
                own = size == s
                at[own] = starts[s] + np.searchsorted(runs[starts[s] : starts[s + 1], 1], rank[own], "right") - 1
            got = runs[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(got[:, 3] + rank - got[:, 1]), pa.array(got[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(offsets, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("before")).alias("rank"))
    kind = ranked.schema["doc_id"].dataType.simpleString()
    return arrow_map(ranked, place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    return pack(SharedTable(pieces_of(docs, vocabulary, ranks, pattern, id_col, text, length), "pieces").df, length)

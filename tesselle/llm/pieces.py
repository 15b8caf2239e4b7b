"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary holds a white-space marker after another character (this is checked
when a model is loaded), so a merge never crosses the place where a run of markers begins. A
text is cut there into marked words; each distinct marked word is segmented once, and the ids
are joined back by position. The table of distinct words is one for each task, of bounded bytes and
emptied by halves when full: the results don't depend on it. (A table for the whole corpus would
shuffle every word of every text with its position; see the README for figures.)

Defined cases: a null text is the empty text and has no ids; an empty table gives an empty
result; repeated rows give repeated results; other columns are ignored. Texts are worked on in runs
of about 2 MB, a longer one alone; a word of over 256 characters is segmented where it is met.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, sliced, strings

MARKER = "▁"
#: Bytes of each half of a task's table, about, and characters of the longest chunk that it keeps.
TABLE_BYTES, LONG = 64 << 20, 256
#: A run of spaces with the word behind it.
CHUNK = re.compile(r" +[^ ]*")

_tables: dict[str, ChunkTable] = {}


class ChunkTable:
    """Distinct marked words with their ids, as ``12,345``, and the decoded text where it differs."""

    def __init__(self, model: str, limit: int = TABLE_BYTES):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(re.search(f"[^{MARKER}]{MARKER}", p) for p in pieces):
            raise ValueError("a piece of this model crosses white space")
        if self.sp.encode("  a b") != self.sp.encode(f"{MARKER} a{MARKER}b"):
            raise ValueError("this model rewrites white space")
        self.alone = self.sp.piece_to_id(MARKER)
        self.lead = self.sp.piece_to_id("a")
        self.text = [str(i) for i in range(len(pieces))]
        self.special = frozenset(i for i in range(len(pieces)) if self.sp.is_byte(i) or self.sp.is_unknown(i) or self.sp.is_control(i))
        self.limit = limit
        self.clear()

    def add(self, chunks: set[str]) -> None:
        missing, size = [], 0
        for chunk in chunks - self.ids.keys():
            size += 200 + 6 * len(chunk)
            if (ids := self.older.get(chunk)) is None:
                missing.append(chunk)
            else:
                self.ids[chunk] = ids
        self.held += size
        if self.held > self.limit:  # what isn't met again goes; these chunks stay
            self.older, self.ids, self.held = self.ids, {}, size
            for chunk in chunks:
                if (ids := self.older.get(chunk)) is not None:
                    self.ids[chunk] = ids
            self.odd = {c: d for c, d in self.odd.items() if c in self.ids or c in self.older}
        self.segment(missing)

    def segment(self, missing: list[str]) -> None:
        # The library puts a marker before what it is given, which stands for a chunk's first space.
        found = self.sp.encode([c[1:] for c in missing], num_threads=1)
        text, special, known = self.text, self.special, self.ids
        for chunk, ids in zip(missing, found, strict=True):
            if chunk == " ":
                ids = [self.alone]
            known[chunk] = ",".join([text[i] for i in ids])
            if not special.isdisjoint(ids):  # other pieces are the text that they stand for
                decoded = self.sp.decode([self.lead, *ids])[1:]
                if decoded != chunk:
                    self.odd[chunk] = decoded

    def clear(self) -> None:
        self.ids, self.older, self.odd, self.held = {}, {}, {}, 0

    def chunks(self, text: str) -> list[str]:
        """Runs of spaces, each with the word behind it; the first has the space that the library adds."""
        return CHUNK.findall(" " + text.replace(MARKER, " ")) if text else []

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids joined by commas, decoded text) of each text."""
        cut = [self.chunks(t) for t in texts]
        every = set().union(*cut)
        long = [c for c in every if len(c) > LONG]
        self.add(every.difference(long) if long else every)
        self.segment(long)  # known for this call only
        get, odd = self.ids.__getitem__, self.odd
        try:
            for text, chunks in zip(texts, cut, strict=True):
                ids = ",".join(map(get, chunks))
                if odd and not odd.keys().isdisjoint(chunks):
                    decoded = "".join([odd.get(c, c) for c in chunks])[1:]
                else:
                    decoded = text.replace(MARKER, " ")
                yield ids, decoded
        finally:
            for chunk in long:
                del self.ids[chunk]
                odd.pop(chunk, None)


def chunk_table(model: str) -> ChunkTable:
    if model not in _tables:
        _tables[model] = ChunkTable(model)
    return _tables[model]


def digest_row(ids: str, decoded: str) -> tuple:
    return ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def real_row(ids: str, decoded: str) -> tuple:
    return [int(i) for i in ids.split(",")] if ids else [], decoded


def encode_decode(
    docs: DataFrame,
    model: str,
    id_col: str = "doc_id",
    text: str = "text",
    row: Callable[[str, str], tuple] = real_row,
    schema: str = "ids array<int>, decoded string",
) -> DataFrame:
    """One row for each document: its id, then what ``row`` makes of (ids, decoded text)."""
    kinds = {"array<int>": pa.list_(pa.int32()), "string": pa.string(), "long": pa.int64()}
    fields = [f.strip().split(" ") for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model)
        table.clear()
        for batch in batches:
            for part in sliced(batch, "text"):
                rows = [row(*x) for x in table.encode(strings(part.column(1)))]
                columns = [pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *(n for n, _ in fields)])
        table.clear()

    narrow = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text}` AS text")
    return arrow_map(narrow, run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, {schema}")


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_decode(docs, model, row=digest_row, schema="n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Tile archives: one binary file of a header, directories, metadata and tile bytes.

``spark.read.format("tilearchive")`` with option ``part`` gives ``entries`` (default), ``header``
(a row) or ``metadata`` (a row of JSON text). The driver reads the header and the root directory
and plans a partition for each run of leaf directories; executors read their leaves by range. The
path must be one that driver and executors can open.

The layout is the published one: numbers are little-endian, directories are columns of varints
(count, id deltas, run lengths, lengths, offsets) and may be compressed with gzip. An entry with run
length 0 points to a further directory, any other one is tiles; both may stand in any directory, and
directories may nest ``MAX_DEPTH`` deep. A directory without entries, or one whose first offset is
coded 0, raises an error.
"""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format.
HEADER_BYTES = 127
MAGIC = 0x4D50
VERSION = 3
COMPRESSIONS = ("unknown", "none", "gzip", "brotli", "zstd")
TILE_TYPES = ("unknown", "mvt", "png", "jpeg", "webp", "avif")
LONGS = ("root_offset", "root_length", "metadata_offset", "metadata_length", "leaf_offset", "leaf_length", "data_offset", "data_length", "addressed_tiles", "tile_entries", "tile_contents")

HEADER_SCHEMA = "spec_version int, " + ", ".join(f"{n} long" for n in LONGS) + ", clustered boolean, internal_compression int, tile_compression int, tile_type int, min_zoom int, max_zoom int, min_lon double, min_lat double, max_lon double, max_lat double, center_zoom int, center_lon double, center_lat double"
#: Directories within directories, which also ends a circle of them.
MAX_DEPTH = 8
ENTRY_SCHEMA = "leaf int, pos long, tile_id long, offset long, length long, run_length long"


def decode_header(raw: bytes) -> dict:
    if len(raw) < HEADER_BYTES or struct.unpack_from("<H", raw)[0] != MAGIC:
        raise ValueError("not a tile archive")
    if raw[7] != VERSION:
        raise ValueError(f"archive version {raw[7]} is not {VERSION}")
    out = {"spec_version": raw[7]} | dict(zip(LONGS, struct.unpack_from("<11Q", raw, 8)))
    if max(out.values()) >= 1 << 63:
        raise ValueError("an offset is beyond 63 bits")
    out["clustered"] = raw[96] == 1
    out |= dict(zip(("internal_compression", "tile_compression", "tile_type", "min_zoom", "max_zoom"), raw[97:102]))
    out |= dict(zip(("min_lon", "min_lat", "max_lon", "max_lat"), (v / 1e7 for v in struct.unpack_from("<4i", raw, 102))))
    out["center_zoom"] = raw[118]
    return out | dict(zip(("center_lon", "center_lat"), (v / 1e7 for v in struct.unpack_from("<2i", raw, 119))))


def encode_header(h: dict) -> bytes:
    raw = bytearray(HEADER_BYTES)
    struct.pack_into("<H", raw, 0, MAGIC)
    raw[2:7] = b"Tiles"
    raw[7] = VERSION
    struct.pack_into("<11Q", raw, 8, *(h.get(n, 0) for n in LONGS))
    raw[96] = int(h.get("clustered", True))
    raw[97:102] = bytes(h.get(n, 0) for n in ("internal_compression", "tile_compression", "tile_type", "min_zoom", "max_zoom"))
    struct.pack_into("<4i", raw, 102, *(round(h.get(n, 0) * 1e7) for n in ("min_lon", "min_lat", "max_lon", "max_lat")))
    raw[118] = h.get("center_zoom", 0)
    struct.pack_into("<2i", raw, 119, *(round(h.get(n, 0) * 1e7) for n in ("center_lon", "center_lat")))
    return bytes(raw)


def decompress(raw: bytes, codec: int) -> bytes:
    """Unknown and none pass through, gzip is unpacked; others are errors."""
    if codec in (0, 1):
        return raw
    if codec == 2:
        return gzip.decompress(raw)
    raise ValueError(f"compression {COMPRESSIONS[codec] if codec < len(COMPRESSIONS) else codec} is not supported")


def varints(raw: bytes) -> np.ndarray:
    """All numbers of a run of varints: 7 bits a byte, lowest first, the last byte below 128."""
    b = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(b < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], last[:-1] + 1])
    if (last - first).max() > 9:
        raise ValueError("a varint has over 10 bytes")
    b = b[: last[-1] + 1]
    shift = (np.arange(len(b)) - np.repeat(first, last - first + 1)).astype(np.uint64) * np.uint64(7)
    found = np.add.reduceat((b & 127).astype(np.uint64) << shift, first)
    if found.max() >= 1 << 63:
        raise ValueError("a varint is beyond 63 bits")
    return found.astype(np.int64)


def encode_varints(numbers) -> bytes:
    out = bytearray()
    for n in numbers:
        n = int(n)
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
    return bytes(out)


def decode_directory(raw: bytes) -> dict[str, np.ndarray]:
    """tile_id, offset, length, run_length of a directory's entries."""
    numbers = varints(raw)
    n = int(numbers[0]) if len(numbers) else 0
    if not n:
        raise ValueError("a directory has no entries")
    if len(numbers) != 1 + 4 * n:
        raise ValueError("a directory is cut short or too long")
    deltas, runs, lengths, coded = numbers[1:].reshape(4, n)
    if coded[0] == 0:
        raise ValueError("a directory begins with offset code 0")
    ahead = np.cumsum(lengths) - lengths
    anchor = np.maximum.accumulate(np.where(coded != 0, np.arange(n), 0))
    return {"tile_id": np.cumsum(deltas), "offset": coded[anchor] - 1 + ahead - ahead[anchor], "length": lengths, "run_length": runs}


def encode_directory(tile_id, offset, length, run_length) -> bytes:
    tile_id, offset, length = (np.asarray(x, np.int64) for x in (tile_id, offset, length))
    coded = offset + 1
    coded[1:][offset[1:] == offset[:-1] + length[:-1]] = 0
    return encode_varints([len(tile_id), *np.diff(tile_id, prepend=0), *run_length, *length, *coded])


def read_range(path: str, offset: int, length: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(offset)
        raw = f.read(length)
    if len(raw) != length:
        raise ValueError("the archive ends within a range")
    return raw


def write_archive(path: str, tiles: list[tuple[int, int, bytes]], metadata: dict, leaf_entries: int = 4, codec: int = 2, **header) -> None:
    """A two-level archive of (tile id, run length, bytes) in id order; equal bytes are stored once."""
    data, places, entries = bytearray(), {}, []
    for tile, run, raw in tiles:
        if raw not in places:
            places[raw] = len(data)
            data += raw
        entries.append((tile, places[raw], len(raw), run))
    packed = gzip.compress if codec == 2 else bytes
    leaves, root = bytearray(), []
    for i in range(0, len(entries), leaf_entries):
        leaf = packed(encode_directory(*zip(*entries[i : i + leaf_entries])))
        root.append((entries[i][0], len(leaves), len(leaf), 0))
        leaves += leaf
    root_raw, meta_raw = packed(encode_directory(*zip(*root))), packed(json.dumps(metadata).encode())
    at = HEADER_BYTES
    h = dict(header, internal_compression=codec, tile_type=1, tile_entries=len(entries), tile_contents=len(places), addressed_tiles=sum(max(1, e[3]) for e in entries))
    for name, raw in (("root", root_raw), ("metadata", meta_raw), ("leaf", leaves), ("data", data)):
        h[f"{name}_offset"], h[f"{name}_length"] = at, len(raw)
        at += len(raw)
    with open(path, "wb") as f:
        f.write(encode_header(h) + root_raw + meta_raw + bytes(leaves) + bytes(data))


def encoded_leaves(entries: DataFrame, codec: int = 2) -> DataFrame:
    """leaf, first (its first tile id), directory (encoded and compressed) and n of entries (leaf, tile_id, offset,
    length, run_length): a leaf, of a bounded number of entries, is a group."""

    def encode(key: tuple, group: pa.Table) -> pa.Table:
        columns = [group.sort_by("tile_id").column(c).to_numpy() for c in ("tile_id", "offset", "length", "run_length")]
        raw = encode_directory(*columns)
        return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), "first": pa.array(columns[0][:1], pa.int64()), "directory": pa.array([gzip.compress(raw, mtime=0) if codec == 2 else raw], pa.binary()), "n": pa.array([len(columns[0])], pa.int64())})

    narrow = entries.selectExpr("CAST(leaf AS LONG) AS leaf", *(f"CAST({c} AS LONG) AS {c}" for c in ("tile_id", "`offset`", "length", "run_length")))
    return narrow.groupBy("leaf").applyInArrow(encode, "leaf long, first long, directory binary, n long")


def decoded_leaves(leaves: DataFrame, codec: int = 2) -> DataFrame:
    """leaf, i, tile_id, offset, length, run_length of encoded directories (leaf, directory)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leaf, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                d = decode_directory(decompress(raw, codec))
                n = len(d["tile_id"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, leaf)), pa.array(np.arange(n, dtype=np.int32)), *(pa.array(d[c]) for c in ("tile_id", "offset", "length", "run_length"))], names=["leaf", "i", "tile_id", "offset", "length", "run_length"])

    return leaves.select("leaf", "directory").mapInArrow(decode, "leaf long, i int, tile_id long, offset long, length long, run_length long")


def write_directories(leaves: DataFrame, path: str, metadata: dict, data_length: int, codec: int = 2, **header) -> None:
    """An archive of encoded leaves (as encoded_leaves() makes them) with an empty data section of a given length.

    The driver holds one leaf at a time, and of each only its first tile id and its place.
    """
    packed = (lambda raw: gzip.compress(raw, mtime=0)) if codec == 2 else bytes
    meta, at, root, entries = packed(json.dumps(metadata).encode()), HEADER_BYTES, [], 0
    h = dict(header, internal_compression=codec, tile_type=1)
    with open(path, "wb") as f:
        f.seek(at)
        f.write(meta)
        h["metadata_offset"], h["metadata_length"] = at, len(meta)
        h["leaf_offset"] = at = at + len(meta)
        for row in leaves.orderBy("first").toLocalIterator():
            f.write(row["directory"])
            root.append((row["first"], at - h["leaf_offset"], len(row["directory"]), 0))
            at, entries = at + len(row["directory"]), entries + row["n"]
        h["leaf_length"] = at - h["leaf_offset"]
        raw = packed(encode_directory(*zip(*root)))
        f.write(raw)
        h["root_offset"], h["root_length"] = at, len(raw)
        h["data_offset"], h["data_length"], h["tile_entries"] = at + len(raw), data_length, entries
        f.truncate(at + len(raw) + data_length)
        f.seek(0)
        f.write(encode_header(h))


class Leaves(InputPartition):
    """Parts of the root in order: (number, offset, length) of a directory, or (number, entries) of tiles in the root itself."""

    def __init__(self, parts: list[tuple], base: int, codec: int):
        self.parts, self.base, self.codec = parts, base, codec


def flattened(path: str, base: int, codec: int, d: dict[str, np.ndarray], depth: int = 1) -> Iterator[dict[str, np.ndarray]]:
    """The tile entries of a directory and of those it points to, in order, a piece at a time."""
    if depth > MAX_DEPTH:
        raise ValueError(f"directories are nested over {MAX_DEPTH} deep")
    points = np.flatnonzero(d["run_length"] == 0)
    start = 0
    for at in [*points, len(d["tile_id"])]:
        if at > start:
            yield {k: v[start:at] for k, v in d.items()}
        if at < len(d["tile_id"]):
            inner = decode_directory(decompress(read_range(path, base + int(d["offset"][at]), int(d["length"][at])), codec))
            yield from flattened(path, base, codec, inner, depth + 1)
        start = at + 1


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.part = options.get("part", "entries")
        self.per_partition = int(options.get("leavespartition", "64"))

    def header(self) -> dict:
        return decode_header(read_range(self.path, 0, HEADER_BYTES))

    def partitions(self) -> list[InputPartition]:
        if self.part != "entries":
            return [InputPartition(0)]
        h = self.header()
        codec = h["internal_compression"]
        root = decode_directory(decompress(read_range(self.path, h["root_offset"], h["root_length"]), codec))
        base, parts, i = h["leaf_offset"], [], 0
        points = root["run_length"] == 0
        while i < len(points):
            if points[i]:
                parts.append((i, int(root["offset"][i]), int(root["length"][i])))
                i += 1
            else:
                stop = i + int(np.argmax(np.append(points[i:], True)))
                parts.append((i, {k: v[i:stop] for k, v in root.items()}))
                i = stop
        return [Leaves(parts[k : k + self.per_partition], base, codec) for k in range(0, len(parts), self.per_partition)]

    def read(self, partition: InputPartition) -> Iterator:
        if self.part == "header":
            h = self.header()
            yield tuple(h[c.split(" ")[0]] for c in HEADER_SCHEMA.split(", "))
        elif self.part == "metadata":
            h = self.header()
            yield (decompress(read_range(self.path, h["metadata_offset"], h["metadata_length"]), h["internal_compression"]).decode(),)
        else:
            for number, *place in partition.parts:
                d = place[0] if len(place) == 1 else decode_directory(decompress(read_range(self.path, partition.base + place[0], place[1]), partition.codec))
                at = 0
                for piece in flattened(self.path, partition.base, partition.codec, d):
                    n = len(piece["tile_id"])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, number, np.int32)), pa.array((np.int64(number) << 32) + at + np.arange(n)), *(pa.array(piece[c]) for c in ("tile_id", "offset", "length", "run_length"))],
                        names=["leaf", "pos", "tile_id", "offset", "length", "run_length"],
                    )
                    at += n


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tilearchive"

    def schema(self) -> str:
        part = self.options.get("part", "entries")
        return {"header": HEADER_SCHEMA, "metadata": "metadata string", "entries": ENTRY_SCHEMA}[part]

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(ArchiveSource)

"""From directory entries to an index: offsets, chunks, packed rows and back.

Running values (sums, maxima) go block by block: within blocks of keys, then over the totals of blocks
the same way, so that the one window without a partition has a row for some 17 million entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import radix64
from .lookup import bucket, splitters

#: Bytes of a chunk, and entries of an index row.
CHUNK_BYTES = 1_000_000
ROW_ENTRIES = 50

BLOCK = 4096


def running(df: DataFrame, value: Column, order: str, out: str, combine=F.max, levels: int = 2, block: int = BLOCK) -> DataFrame:
    """Adds ``combine`` (max or sum) of ``value`` over all rows with a lower ``order``, a unique whole number; null for the first."""
    if levels == 0:
        return df.withColumn(out, combine(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    name, total, ahead = (f"_{x}{levels}" for x in ("block", "total", "ahead"))
    inner = Window.partitionBy(name).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocked = df.withColumn(name, F.expr(f"`{order}` div {block}"))
    totals = blocked.groupBy(name).agg(combine(value).alias(total))
    totals = running(totals, F.col(total), name, ahead, combine, levels - 1, block).select(name, ahead)
    joined = blocked.withColumn(out, combine(value).over(inner)).join(totals, name)
    merged = F.coalesce(F.col(out) + F.col(ahead), out, ahead) if combine is F.sum else F.array_max(F.array(out, ahead))
    return joined.withColumn(out, merged).drop(name, ahead)


def prefix_sum(df: DataFrame, value: str, order: str, out: str, levels: int = 2, block: int = BLOCK) -> DataFrame:
    """Adds the sum of ``value`` over all rows with a lower ``order``, which is a unique whole number."""
    return running(df, F.col(value), order, out, F.sum, levels, block).withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


def undelta(df: DataFrame, delta: str, group: str, order: str, out: str) -> DataFrame:
    """Running sum of deltas within each directory."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(delta).over(w).cast("long"))


def fill_offsets(df: DataFrame, coded: str, length: str, group: str, order: str, out: str) -> DataFrame:
    """Offsets of a directory: a coded 0 continues behind the previous entry, otherwise the offset is coded - 1.

    A directory whose first coded offset is 0 is broken and raises an error.
    """
    ahead = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = df.withColumn("_cum", F.coalesce(F.sum(length).over(ahead), F.lit(0)))
    anchor = F.when(F.col(coded) != 0, F.col(coded) - 1 - F.col("_cum"))
    shift = F.last(anchor, ignorenulls=True).over(upto)
    offset = F.when(shift.isNull(), F.raise_error(F.lit("a directory begins with offset code 0")).cast("long")).otherwise(F.col("_cum") + shift)
    return run.withColumn(out, offset.cast("long")).drop("_cum")


def chunk_of(offset: Column, size: int = CHUNK_BYTES) -> Column:
    """Chunk of an entry, by its first byte; a chunk may reach over its nominal end."""
    return F.call_function("div", offset, F.lit(size))


def running_max_chunk(entries: DataFrame, block: int = BLOCK, position: str = "pos") -> DataFrame:
    """Adds prev_max, the largest chunk_id of any earlier entry, block by block."""
    return running(entries, F.col("chunk_id"), position, "prev_max", block=block)


def in_order(entries: DataFrame, **kw) -> DataFrame:
    """Entries that do not fall back to a chunk before the one being written."""
    return running_max_chunk(entries, **kw).where("prev_max IS NULL OR chunk_id >= prev_max").drop("prev_max")


def boundaries(entries: DataFrame, block: int = BLOCK, position: str = "pos") -> DataFrame:
    """Entries that begin another chunk than the previous entry is in; the first one too."""
    seen = running(entries, F.struct(F.col(position).alias("at"), F.col("chunk_id").alias("chunk")), position, "_prev", block=block)
    return seen.where("_prev IS NULL OR NOT (_prev.chunk <=> chunk_id)").drop("_prev")


def chunks(entries: DataFrame) -> DataFrame:
    """chunk_id, start_byte, end_byte and the number of entries of each chunk."""
    end = F.col("offset") + F.col("length")
    return entries.groupBy("chunk_id").agg(F.min("offset").alias("start_byte"), F.max(end).alias("end_byte"), F.count(F.lit(1)).alias("n_entries"))


def disordered(entries: DataFrame) -> DataFrame:
    """Chunks in which an entry begins before the first one that was met; there should be none."""
    return entries.groupBy("chunk_id").agg(F.min("offset").alias("low"), F.min_by("offset", "pos").alias("first")).where("low < first")


def relative(entries: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """Entries with the offset within their chunk. The chunks are fewer than the entries by far, but grow
    with the archive; Spark broadcasts them only while they are small."""
    joined = entries.join(chunk_rows.select("chunk_id", "start_byte"), "chunk_id")
    return joined.withColumn("chunk_offset", F.col("offset") - F.col("start_byte")).drop("start_byte")


def pack(entries: DataFrame, per_row: int = ROW_ENTRIES) -> DataFrame:
    """Index rows (start_tile_id, entry) of up to ``per_row`` consecutive entries of a leaf.

    ``entry`` is ``<first tile>|<first offset>`` followed by a ``:`` and, for each entry,
    ``<tile delta>|<offset delta>|<length>|<run length>|<chunk>:``, all in base 64; the deltas
    are against the row's first tile and offset.
    """
    by_leaf = Window.partitionBy("leaf").orderBy("pos")
    numbered = entries.withColumn("_nth", F.row_number().over(by_leaf)).withColumn("_row", F.expr(f"(_nth - 1) div {per_row}"))
    fields = ["tile_id", "chunk_offset", "length", "run_length", "chunk_id"]
    rows = numbered.groupBy("leaf", "_row").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("es"))
    e = F.col("es")

    first = F.get(e, F.lit(0))

    def text(x: Column) -> Column:
        parts = (x["tile_id"] - first["tile_id"], x["chunk_offset"] - first["chunk_offset"], x["length"], x["run_length"], x["chunk_id"])
        return F.concat(F.concat_ws("|", *(radix64.encode(p) for p in parts)), F.lit(":"))

    head = F.concat(radix64.encode(e[0]["tile_id"]), F.lit("|"), radix64.encode(e[0]["chunk_offset"]), F.lit(":"))
    return rows.select(e[0]["tile_id"].alias("start_tile_id"), F.concat(head, F.array_join(F.transform(e, text), "")).alias("entry"), F.size("es").alias("n_entries"))


def unpack(rows: DataFrame) -> DataFrame:
    """Entries of packed index rows: start_tile_id, i, tile_id, chunk_offset, length, run_length, chunk_id."""
    pieces = F.filter(F.split("entry", ":"), lambda s: s != "")
    cut = rows.select("start_tile_id", F.transform(pieces, lambda s: F.split(s, r"\|")).alias("p"))
    number = lambda s, i: radix64.decode(F.get(s, F.lit(i)))
    head = F.get(F.col("p"), F.lit(0))
    entries = F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda s: F.struct(*(number(s, i).alias(n) for i, n in enumerate(("dt", "do", "length", "run_length", "chunk_id")))))
    out = cut.select("start_tile_id", number(head, 0).alias("t0"), number(head, 1).alias("o0"), F.posexplode(entries).alias("i", "e"))
    return out.select("start_tile_id", "i", (F.col("t0") + F.col("e.dt")).alias("tile_id"), (F.col("o0") + F.col("e.do")).alias("chunk_offset"), "e.length", "e.run_length", "e.chunk_id")


def overlapping(entries: DataFrame, cuts: list | None = None) -> DataFrame:
    """Entries whose run reaches into the next entry by tile id, wherever that lies; a sound index has none.

    Of entries that share a tile id the one of the lower pos comes first.
    """
    cuts = splitters(entries, "tile_id") if cuts is None else cuts
    ranged = entries.withColumn("_range", bucket(F.col("tile_id"), cuts))
    # One row for each range that has entries, of as many as lookups have buckets at most.
    firsts = ranged.groupBy("_range").agg(F.min("tile_id").alias("_first"))
    ahead = firsts.select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_ahead"))
    w = Window.partitionBy("_range").orderBy("tile_id", "pos")
    own = ranged.withColumn("_next", F.lead("tile_id").over(w)).join(ahead, "_range")
    return own.where("coalesce(_next, _ahead) < tile_id + run_length").drop("_range", "_next", "_ahead")


def with_metadata(rows: DataFrame, metadata: str) -> DataFrame:
    """Index rows and the row of key -1 whose entry is the archive's metadata."""
    return rows.select("start_tile_id", "entry").unionByName(rows.sparkSession.createDataFrame([(-1, metadata)], "start_tile_id long, entry string"))


def metadata_row(rows: DataFrame) -> DataFrame:
    return rows.where("start_tile_id = -1").limit(1)

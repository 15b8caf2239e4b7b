"""Tile lookups: the index entry at or before a key, and whether its run holds the key.

Spark plans an inequality join as a nested loop. A small index is instead held as one sorted array
of its start keys: a binary search finds the start at or before each probe, which then is an
ordinary join key. Of a larger one keys are cut into buckets at quantiles of both sides together,
so that neither many entries nor many keys asked for meet in one task; within a bucket entries
and distinct keys are put in one order, and the last entry seen is carried to each key. What
precedes a bucket comes from the last entry of an earlier one. Equal keys are asked once and joined
back, so a popular tile costs one row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.curve import MAX_ZOOM, in_bounds, tile_id

#: Rows of a bucket, about: index entries and distinct keys asked for.
BUCKET_ROWS = 100_000
#: Index rows up to which their start keys are held as one array, of 8 bytes each.
SMALL_INDEX = 20_000
#: Values that a quantile sketch keeps, which places a cut within some 0.02 % of the rows.
SKETCH = 16_384


def splitters(keys: DataFrame, key: str, rows: int = BUCKET_ROWS) -> list:
    """Keys that begin buckets of about ``rows``, at quantiles of the keys; one pass, 8 bytes for each bucket."""
    sketch = keys.agg(F.kll_sketch_agg_bigint(F.col(key).cast("long"), F.lit(SKETCH)).alias("s"))
    got = sketch.select("s", F.kll_sketch_get_n_bigint("s").alias("n")).first()
    buckets = (got["n"] or 0) // rows + 1
    if buckets < 2:
        return []
    ranks = F.lit(np.arange(1, buckets) / buckets)
    found = keys.sparkSession.range(1).select(F.kll_sketch_get_quantile_bigint(F.lit(bytes(got["s"])), ranks).alias("q")).first()
    return sorted({int(x) for x in found["q"]})


def at_or_before(key: Column, starts: np.ndarray) -> Column:
    """Number of ``starts``, which ascend, that are not above the key: a binary search in a constant array."""
    if not len(starts):
        return F.lit(0)
    steps = np.array([1 << b for b in range(len(starts).bit_length() - 1, -1, -1)], np.int32)
    array = F.lit(np.asarray(starts, np.int64))
    inside = lambda at: F.coalesce(F.get(array, at - 1) <= key, F.lit(False))
    return F.aggregate(F.lit(steps), F.lit(0), lambda n, step: F.when(inside(n + step), n + step).otherwise(n))


def bucket(key: Column, cuts: list) -> Column:
    """Number of splitters at or below the key."""
    return at_or_before(key.cast("long"), np.array(cuts, np.int64))


def asof_lookup(probes: DataFrame, index: DataFrame, probe_key: str = "tile_id", index_key: str = "start_tile_id", prefix: str = "entry_", cuts: list | None = None, small: int = SMALL_INDEX) -> DataFrame:
    """``probes`` with the columns of the last index row whose key is not above theirs, null where there is none.

    Index keys are taken as unique; of equal ones the row that sorts last counts. A null probe
    key finds nothing, a null index key is never found. Cuts that are given are used at any size.
    """
    rest = [c for c in index.columns if c != index_key]
    known = index.where(F.col(index_key).isNotNull())
    entry = F.struct(F.col(index_key).alias("k"), *(F.col(c) for c in rest))
    if cuts is None:
        starts = known.select(F.col(index_key).cast("long").alias("k")).limit(small + 1).toArrow().column("k").to_numpy()
        if len(starts) <= small:
            starts = np.unique(starts)
            at = at_or_before(F.col(probe_key).cast("long"), starts)
            asked = probes.withColumn("_k", F.get(F.lit(starts), at - 1) if len(starts) else F.lit(None).cast("long"))
            found = known.groupBy(F.col(index_key).cast("long").alias("_start")).agg(F.max(entry).alias("_e"))
            return _with_entry(asked.join(found, F.col("_k") == F.col("_start"), "left"), probes, index_key, rest, prefix)
    entries = known.select(F.col(index_key).cast("long").alias("k"), F.lit(0).alias("side"), entry.alias("e"))
    asked = probes.where(F.col(probe_key).isNotNull()).select(F.col(probe_key).cast("long").alias("k")).distinct()
    if cuts is None:
        cuts = splitters(entries.select("k").unionByName(asked), "k")
    asked = asked.select("k", F.lit(1).alias("side"), F.lit(None).cast(entries.schema["e"].dataType).alias("e"))
    both = entries.unionByName(asked).withColumn("b", bucket(F.col("k"), cuts))
    order = Window.partitionBy("b").orderBy("k", "side", "e").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("e", F.last("e", ignorenulls=True).over(order)).where("side = 1")
    if cuts:
        # A row for each bucket, of BUCKET_ROWS rows each; the carry reaches over buckets without entries.
        last = entries.withColumn("b", bucket(F.col("k"), cuts)).groupBy("b").agg(F.max("e").alias("e"))
        every = probes.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("b"))
        before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        carry = every.join(last, "b", "left").select("b", F.last("e", ignorenulls=True).over(before).alias("carry"))
        found = found.join(carry, "b", "left").withColumn("e", F.coalesce("e", "carry"))
    found = found.select(F.col("k").alias("_k"), F.col("e").alias("_e"))
    return _with_entry(probes.join(found, probes[probe_key] == found["_k"], "left"), probes, index_key, rest, prefix)


def _with_entry(joined: DataFrame, probes: DataFrame, index_key: str, rest: list[str], prefix: str) -> DataFrame:
    return joined.select(*(F.col(f"`{c}`") for c in probes.columns), F.col("_e.k").alias(f"{prefix}{index_key}"), *(F.col(f"_e.{c}").alias(f"{prefix}{c}") for c in rest))


def point_lookup(index: DataFrame, key: int, index_key: str = "start_tile_id") -> DataFrame:
    """The last row whose key is not above ``key``: a pushed-down filter and a top-1."""
    return index.where(F.col(index_key) <= key).orderBy(F.col(index_key).desc()).limit(1)


def contains(key: Column, start: Column, run_length: Column) -> Column:
    """Whether a run holds the key; a run of length 0 holds its own start."""
    return F.coalesce((key >= start) & (key < start + F.greatest(run_length, F.lit(1))), F.lit(False))


def locate(requests: DataFrame, index: DataFrame, minzoom: int = 0, maxzoom: int = MAX_ZOOM) -> DataFrame:
    """Requests (z, x, y) with tile_id, the entry that holds it, and a status.

    500 for coordinates out of bounds, which is tested first; 404 for a zoom that the archive
    lacks or a tile that no run holds; 200 otherwise.
    """
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    ids = requests.withColumn("tile_id", tile_id(z, x, y))
    found = asof_lookup(ids, index)
    hit = contains(F.col("tile_id"), F.col("entry_start_tile_id"), F.col("entry_run_length")) & z.between(minzoom, maxzoom)
    status = F.when(~in_bounds(z, x, y), 500).when(hit, 200).otherwise(404)
    entry = [c for c in found.columns if c.startswith("entry_")]
    return found.withColumn("status", status).withColumns({c: F.when(F.col("status") == 200, F.col(c)) for c in entry})


def read_ranges(located: DataFrame, blobs: DataFrame, blob_key: str = "chunk_id", data: str = "data") -> DataFrame:
    """Bytes [offset, offset + length) of each located entry's blob, as column ``bytes``; null where there is no blob.

    The distinct ranges of a blob are cut in one go, so that a blob is shuffled once whatever the
    number of entries in it; only what was cut goes back to the entries.
    """
    span = F.struct(F.col("offset").cast("long").alias("o"), F.col("length").cast("long").alias("n"))
    ranges = located.where(F.col(blob_key).isNotNull()).groupBy(F.col(blob_key).alias("_b")).agg(F.collect_set(span).alias("_r"))
    cut = blobs.select(F.col(blob_key).alias("_b"), F.col(data).alias("_d")).join(ranges, "_b").select("_b", F.col("_d"), F.explode("_r").alias("_x"))
    cut = cut.select("_b", F.col("_x.o").alias("_o"), F.col("_x.n").alias("_n"), F.substr("_d", (F.col("_x.o") + 1).cast("int"), F.col("_x.n").cast("int")).alias("bytes"))
    own = (located[blob_key] == cut["_b"]) & (located["offset"] == cut["_o"]) & (located["length"] == cut["_n"])
    return located.join(cut, own, "left").drop("_b", "_o", "_n")

"""Index tables and chunk objects: written as new versions, then published by a pointer and a view."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .archive import read_range

#: Fixed value: seconds that a replaced version stays.
RETIRE_SECONDS = 10.0
#: The file that names the live version; Spark's readers skip names that begin with ``_``.
POINTER = "_live"


#: Columns of an index table, none of which may be null; the key is unique.
INDEX_SCHEMA = "start_tile_id BIGINT NOT NULL, entry STRING NOT NULL"


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` as it is; a null in one of the columns is an error when it is read."""
    return df.withColumns({c: F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} is null")).cast(df.schema[c].dataType)) for c in columns})


def repeated_keys(rows: DataFrame, key: str = "start_tile_id") -> DataFrame:
    """Keys that more than one row has; an index has none."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def write_index(rows: DataFrame, path: str, deployment_key: str, files: int | None = None) -> str:
    """Index rows sorted by key over the files, so that row groups can be skipped; returns the place.

    A null key or entry is an error, and leaves no version to publish.
    """
    place = f"{path}/deployment={deployment_key}"
    not_null(rows, "start_tile_id", "entry").repartitionByRange(*([files] if files else []), "start_tile_id").sortWithinPartitions("start_tile_id").write.mode("overwrite").parquet(place)
    return place


def create_index(spark: SparkSession, name: str, place: str, metadata: str | None = None) -> None:
    """A catalogue table over a place, empty or with what is written there; the metadata goes into the row of key -1."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({INDEX_SCHEMA}) USING parquet LOCATION '{place}'")
    if metadata is not None:
        spark.sql(f"INSERT INTO {name} VALUES (-1, ?)", args=[metadata])


def _files(spark: SparkSession, path: str):
    """(file system, path, class of paths) of a place on any store."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark._jsc.hadoopConfiguration()), kind(path), kind


def publish(spark: SparkSession, name: str, place: str, now: float | None = None) -> None:
    """Make a written version the live one, for this session's view and for every other reader.

    The pointer beside the versions names the live one and since when, and keeps the history of
    earlier ones. It is written aside and then renamed, so readers see the old or the new one, whole.
    """
    path, _, version = place.rstrip("/").rpartition("/")
    fs, root, kind = _files(spark, path)
    history = [h for h in versions(spark, path) if h["version"] != version] + [{"version": version, "since": time.time() if now is None else now}]
    draft, pointer = kind(root, f"_live-{uuid.uuid4().hex}"), kind(root, POINTER)
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(history).encode()))
    out.close()
    fs.delete(pointer, False)  # a reader between the two steps tries again
    if not fs.rename(draft, pointer):
        raise OSError(f"{pointer} was not replaced")
    spark.read.parquet(place).createOrReplaceTempView(name)


def versions(spark: SparkSession, path: str) -> list[dict]:
    """version and since (seconds) of what was published below ``path``, the live one last."""
    fs, root, kind = _files(spark, path)
    for attempt in range(5):
        if fs.exists(kind(root, POINTER)):
            stream = fs.open(kind(root, POINTER))
            try:
                return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        if not fs.exists(root) or not any(s.getPath().getName().startswith("_live-") for s in fs.listStatus(root)):
            break
        time.sleep(backoff_ms(attempt) / 10_000)
    return []


def live(spark: SparkSession, path: str) -> DataFrame | None:
    """The live version, for a reader that knows only the place."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/{found[-1]['version']}") if found else None


def published(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def retire(spark: SparkSession, path: str, live_key: str, delay: float = RETIRE_SECONDS, now: float | None = None) -> list[str]:
    """Delete the versions below ``path`` that are not the live one; returns their names.

    A version that was replaced less than ``delay`` seconds ago stays, as readers may still hold it.
    """
    fs, root, _ = _files(spark, path)
    now, history, gone = time.time() if now is None else now, versions(spark, path), []
    until = {old["version"]: new["since"] for old, new in zip(history, history[1:])}
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("deployment=") and name != f"deployment={live_key}" and now - until.get(name, 0.0) >= delay:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def query(spark: SparkSession, sql: str, *values) -> DataFrame:
    """A statement with a ``?`` for each value."""
    return spark.sql(sql, args=list(values))


def write_chunks(chunks: DataFrame, path: str, deployment_key: str) -> None:
    """Chunk objects (chunk_id, data) of a version, as a table with an object a row."""
    named = chunks.withColumn("name", F.format_string("chunk_%d.pmtiles", "chunk_id"))
    named.write.mode("overwrite").parquet(f"{path}/{deployment_key}/chunks")


def cut_chunks(chunks: DataFrame, archive: str, data_offset: int) -> DataFrame:
    """chunk_id and data of chunks (chunk_id, start_byte, end_byte), read by range from an archive's data
    section. Executors open the archive, so it must be on a mounted store; a batch is one chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = read_range(archive, data_offset + start, end - start)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([raw], pa.binary())], names=["chunk_id", "data"])

    narrow = chunks.select(F.col("chunk_id").cast("long"), F.col("start_byte").cast("long"), F.col("end_byte").cast("long"))
    return narrow.mapInArrow(cut, "chunk_id long, data binary")


def write_objects(chunks: DataFrame, folder: str) -> DataFrame:
    """Write each chunk (chunk_id, data) as an object of its own below a mounted folder; name and bytes of each.

    An object is written aside and renamed, so a task that runs twice leaves one whole object.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = f"chunk_{chunk}.pmtiles"
                draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
                with open(draft, "wb") as f:
                    f.write(raw)
                os.replace(draft, f"{folder}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(raw)], pa.int64())], names=["name", "bytes"])

    return chunks.select(F.col("chunk_id").cast("long"), "data").mapInArrow(put, "name string, bytes long")


def read_objects(spark: SparkSession, path: str, deployment_key: str) -> DataFrame:
    """Whole objects below a version's prefix: path, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/{deployment_key}")


def refresh_cache(cache: DataFrame, responses: DataFrame, keys: tuple[str, ...] = ("url",), order: str | None = None) -> DataFrame:
    """Cached responses overwritten by new ones with the same key, one for each key.

    Of several new ones the last by ``order`` counts, and of equal ones, or without an order, the
    one whose columns sort last.
    """
    row = F.struct(*(F.col(c) for c in responses.columns))
    rank = F.struct(F.col(order), row) if order else row
    last = responses.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max_by(row, rank).alias("_row")).select("_row.*")
    return cache.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


@contextmanager
def hot(df: DataFrame):
    """A table kept in memory, and on disk where that is short, while the block runs: what lookups read again and again."""
    kept = df.persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def counted(df: DataFrame, name: str, **sums: str) -> tuple[DataFrame, Observation]:
    """``df`` with progress counters: when a write of it has run, ``.get`` has rows and the sums of the named columns."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.sum(c).alias(n) for n, c in sums.items())), seen


def backoff_ms(attempt: int) -> float:
    """Wait before a retry: 1000 * 1.5^attempt milliseconds."""
    return 1000 * 1.5**attempt

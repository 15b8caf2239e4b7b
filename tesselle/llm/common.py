"""What several operators share: tables in the shared folder, row keys, batch slicing."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor reach, from ``spark.checkpoint.dir``.

    Only where that is unset and all of Spark is on one machine, as in tests, a folder of our own
    is made and set. On a cluster a folder of one machine would lose rows, so that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tesselle-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class SharedTable:
    """A written table; it cuts the lineage, and a lost executor takes nothing of it along."""

    #: Tables that were written and not dropped yet, by path.
    alive: dict[str, SharedTable] = {}

    def __init__(self, df: DataFrame, name: str, partition_by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tesselle/{name}-{uuid.uuid4().hex}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path)
        self.schema = df.schema
        SharedTable.alive[self.path] = self

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files, once nothing lazy reads them any more."""
        SharedTable.alive.pop(self.path, None)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch() -> Iterator[Callable[[SharedTable], SharedTable]]:
    """Tables written inside are dropped at the end, but those given to the function that it yields."""
    before, keep = set(SharedTable.alive), set()

    def spare(table: SharedTable) -> SharedTable:
        keep.add(table.path)
        return table

    try:
        yield spare
    finally:
        for path in [p for p in SharedTable.alive if p not in before and p not in keep]:
            SharedTable.alive[path].drop()


def drop_tables() -> None:
    """Delete what results of this process have read, once all of them have been used."""
    for one in list(SharedTable.alive.values()):
        one.drop()


#: Bytes of a batch that goes to Python; both sides hold a few of them at a time.
BATCH_BYTES = 4 << 20


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow() with small batches: the session's limit by bytes is lowered and stays so."""
    conf = df.sparkSession.conf
    if (size := re.fullmatch(r"(\d+)b?", conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))) and int(size[1]) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def release() -> None:
    """Give freed memory back to the system: workers wait for further tasks, several to an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def settle() -> None:
    """Let the driver forget what nothing refers to, so that shuffle files of finished steps go."""
    gc.collect()
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, a null one as the empty one."""
    return F.coalesce(F.col(f"`{col}`"), F.lit(""))


def row_key(id_col: str = "doc_id", text: str = "text") -> list[Column]:
    """k0 and k1: 120 bits of the SHA-256 of a row's id and text, which name the row. Only rows that share id and text share them."""
    own = F.col(f"`{id_col}`")
    owner = F.when(own.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), own.cast("string"), F.lit("\0")))
    digest = F.sha2(F.concat(owner, whole_text(text)).cast("binary"), 256)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(f"k{n}") for n, at in enumerate((1, 16))]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_key(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with its row key in two columns more, whose names are returned."""
    names = fresh(docs, "_k0", "_k1")
    return docs.select("*", *(k.alias(n) for k, n in zip(row_key(id_col, text), names))), names


def one_of_each(docs: DataFrame, keys: DataFrame, id_col: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose key (k0, k1) is in ``keys``, one of each; n is the number of rows with the key."""
    keyed, names = with_key(docs, id_col, text)
    once = keys.select(*(F.col(k).alias(n) for k, n in zip(("k0", "k1"), names)), "n")
    out = keyed.join(once.where("n = 1").drop("n").hint("merge"), names, "left_semi")
    if not keys.where("n > 1").isEmpty():
        (nth,) = fresh(keyed, "_nth")
        several = keyed.join(once.where("n > 1").drop("n").hint("merge"), names, "left_semi")
        several = several.withColumn(nth, F.row_number().over(Window.partitionBy(*names).orderBy(names[0]))).where(F.col(nth) == 1).drop(nth)
        out = out.unionByName(several)
    return out.drop(*names)


def sliced(batch: pa.RecordBatch, text: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about ``limit`` bytes, one row at least."""
    n = batch.num_rows
    if not n:
        return
    _, ends = text_buffers(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < n:
        stop = int(np.searchsorted(ends, ends[start] + limit, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without a copy; a null has no bytes."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]

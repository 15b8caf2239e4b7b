"""Exact deduplication with a heavy-hitter split, in built-in DataFrame operations only.

Texts are equal when they are identical after each run of white space became one space.
A Misra-Gries summary (Spark's ``approx_top_k`` functions keep the frequent-items sketch of that
family) names the digests that may be frequent; their counts are then verified exactly.
The verified winners, at most ``max_winners`` rows, are broadcast and settled on the map
side; every other digest is shared by a small part of the rows only and is shuffled.

Defined cases: a null text is the empty text. Of rows with equal text the smallest doc_id
stays, a null doc_id only where all are null; rows that also share the doc_id count as copies
and just one of them stays. A text of any length is one digest. An empty table gives an empty result.
Other columns are ignored, or kept by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SharedTable, one_of_each, row_key, whole_text

#: At most so many digests are settled by a broadcast: 1024 rows of about 120 bytes.
MAX_WINNERS = 1024
#: Counters of a Misra-Gries summary. A digest with over a 1/12,000 of the rows can't be missed.
TRACKED = 16384
#: Groups that summaries are merged in, the square of it at first.
SALTS = 32


def text_digest(text: str = "text"):
    return F.sha2(F.regexp_replace(whole_text(text), SPACE, " ").cast("binary"), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text_digest(text).alias("text_sha256"), *row_key(id_col, text))


def frequent(rows: DataFrame, max_winners: int = MAX_WINNERS, tracked: int = TRACKED, salts: int = SALTS) -> DataFrame:
    """text_sha256 of digests that may be frequent, ``max_winners`` at most.

    Summaries of the tasks are merged in three steps, so that no reducer meets those of all tasks.
    """
    salt = F.pmod(F.spark_partition_id(), F.lit(salts * salts)).alias("salt")
    some = rows.select("text_sha256", salt).groupBy("salt").agg(F.expr(f"approx_top_k_accumulate(text_sha256, {tracked})").alias("s"))
    some = some.groupBy(F.expr(f"salt div {salts}").alias("salt")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"))
    top = some.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s")).select(F.expr(f"approx_top_k_estimate(s, {max_winners})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("text_sha256"))


def grouped(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_winners: int = MAX_WINNERS, tracked: int = TRACKED) -> DataFrame:
    """One row for each row of ``docs``: doc_id, k0, k1, row, text_sha256, first (of its group), group_size."""
    rows = digests(docs, id_col, text).withColumn("row", F.monotonically_increasing_id())
    rows = SharedTable(rows, "digests").df  # three passes read 70 bytes a document instead of its text
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    known = SharedTable(frequent(rows, max_winners, tracked), "frequent")
    winners = rows.join(F.broadcast(known.df), "text_sha256").groupBy("text_sha256").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("group_size"))
    winners = SharedTable(winners.where("group_size > 1"), "winners").df
    known.drop()

    heavy = rows.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    light = rows.join(F.broadcast(winners), "text_sha256", "left_anti")
    light = light.withColumns({"first": F.min(place).over(group), "group_size": F.count(F.lit(1)).over(group)})
    return heavy.select(light.columns).unionByName(light)


def group_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    kept = F.col("row") == F.col("first.row")
    return grouped(docs, id_col, text, **options).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = grouped(docs, id_col, text, **options)
    keys = found.groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("row") == F.col("first.row")).alias("kept"))
    return one_of_each(docs, SharedTable(keys.where("kept").select("k0", "k1", "n"), "copies").df, id_col, text)

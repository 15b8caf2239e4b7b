"""Chat formatting after a collapse of cumulative snapshots, in built-in DataFrame operations only.

A log often holds a conversation again and again as it grows. Each prefix of a conversation has
a rolling hash, the sum over its turns of a hash of (position, turn), so that a prefix is known
by its length and 128 bits of sums. A conversation that equals a strict prefix of another one is
removed by an anti-join on the prefixes; of equal ones that with the least conv_id stays. What
remains is rendered as chat markup.

Turns are dealt to ranges of (conversation, turn). Positions and sums are made range by range and
moved on by the totals of earlier ranges, so no task needs a whole conversation. Rendering
groups ``SEGMENT`` consecutive messages into a row: nearly every conversation is one row, and a
conversation of any length is the concatenation of its rows.

Defined cases: a null role or text is the empty string. A null turn comes first; turns with the
same number are in the order of a hash of role and text. Repeated rows (same conversation, turn,
role and text) are one turn. Each row with a null conv_id is a conversation of its own. Markup
inside a role or text is defused. A very long conversation is several rows; a very long text is in one of
them. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedTable

#: Messages in a rendered row, at most.
SEGMENT = 512
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

KEY = ["conv_id", "alone"]
TURN = [*KEY, "turn", "d1", "d2"]


def turns(conversations: DataFrame) -> DataFrame:
    """Keys, digests, role and text of each turn; ``alone`` tells rows without a conv_id apart."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    plain = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    plain = plain.withColumns({"d1": F.xxhash64("role", "text"), "d2": F.xxhash64("text", F.lit(1), "role")})
    return plain.withColumn("alone", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "d1", "d2")).otherwise(F.lit(0)))


def positions(turned: DataFrame) -> DataFrame:
    """TURN, pos, n (turns of the conversation), h1 and h2 (hashes of the prefix that ends here)."""
    distinct = turned.select(TURN).distinct()
    ranged = distinct.repartitionByRange(*TURN).withColumn("block", F.spark_partition_id())
    ranged = SharedTable(ranged, "turns").df
    inner = Window.partitionBy("block", *KEY).orderBy("turn", "d1", "d2").rowsBetween(Window.unboundedPreceding, 0)

    def moved_on(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
        """Adds to each running value the totals of the conversation's earlier blocks."""
        totals = rows.groupBy("block", *KEY).agg(*(F.max(c).alias(f"{c}_all") for c in sums))
        before = Window.partitionBy(*KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*KEY)
        totals = totals.select("block", *KEY, *(F.coalesce(F.sum(f"{c}_all").over(before), F.lit(0)).alias(f"{c}_before") for c in sums), *(F.sum(f"{c}_all").over(whole).alias(f"{c}_total") for c in sums))
        t = SharedTable(totals, "totals").df.withColumnsRenamed({"block": "_block", **{k: f"_{k}" for k in KEY}})
        joined = rows.join(t, (rows["block"] == t["_block"]) & rows["conv_id"].eqNullSafe(t["_conv_id"]) & (rows["alone"] == t["_alone"]))
        return joined.withColumns({c: F.col(c) + F.col(f"{c}_before") for c in sums})

    counted = ranged.withColumn("pos", F.row_number().over(inner).cast("long"))
    placed = moved_on(counted, {"pos": F.col("pos")}).select("block", *TURN, "pos", F.col("pos_total").alias("n"))
    placed = SharedTable(placed, "positions").df
    low = F.lit(0xFFFFFFFF)
    parts = {}
    for name, digest in (("a", F.xxhash64("pos", "d1")), ("b", F.xxhash64("d2", "pos"))):
        parts[f"{name}0"] = digest.bitwiseAND(low)
        parts[f"{name}1"] = F.shiftrightunsigned(digest, 32)
    sums = placed.select("block", *TURN, "pos", "n", *(F.sum(c).over(inner).alias(name) for name, c in parts.items()))
    # Halves of 32 bits: their sums stay exact, and grow with each turn, so a block's total is its largest.
    out = moved_on(SharedTable(sums, "sums").df, {name: F.col(name) for name in parts})
    return out.select(*TURN, "pos", "n", F.xxhash64("a0", "a1").alias("h1"), F.xxhash64("b0", "b1").alias("h2"))


def maximal(placed: DataFrame) -> DataFrame:
    """KEY and n_copies of the conversations that stay."""
    whole = placed.where("pos = n").groupBy("pos", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), *KEY)).alias("first"), F.count(F.lit(1)).alias("n_copies"))
    prefixes = placed.where("pos < n").select("pos", "h1", "h2").distinct()
    return whole.join(prefixes, ["pos", "h1", "h2"], "left_anti").select("first.conv_id", "first.alone", "n_copies")


def defused(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(OPEN), F.lit("<im_start>")), F.lit(CLOSE), F.lit("<im_end>"))


def message(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), defused(role), F.lit("\n"), defused(text), F.lit(CLOSE), F.lit("\n"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_{k}"])
    return right, on


def render(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, segment, n_segments, n_turns, n_copies, text of the conversations that stay."""
    turned = turns(conversations)
    placed = SharedTable(positions(turned), "placed").df
    kept = SharedTable(maximal(placed), "maximal").df
    right, on = _null_safe(placed, kept, KEY)
    wanted = placed.join(right, on).select(*TURN, "pos", "n", "n_copies")
    wanted = SharedTable(wanted, "wanted").df
    right, on = _null_safe(turned, wanted, TURN)
    once = turned.groupBy(TURN).agg(F.first("role").alias("role"), F.first("text").alias("text"))  # repeats of a turn, before they meet
    rows = once.join(right, on).select(*KEY, "pos", "n", "n_copies", message(F.col("role"), F.col("text")).alias("message"))
    rows = rows.withColumn("segment", F.expr(f"cast((pos - 1) div {segment} as int)"))
    joined = rows.groupBy(*KEY, "segment", "n", "n_copies").agg(F.array_sort(F.collect_set(F.struct("pos", "message"))).alias("m"))
    return joined.select(
        "conv_id",
        "segment",
        F.expr(f"cast((n + {segment - 1}) div {segment} as int)").alias("n_segments"),
        F.col("n").alias("n_turns"),
        "n_copies",
        F.array_join(F.col("m.message"), "").alias("text"),
    )

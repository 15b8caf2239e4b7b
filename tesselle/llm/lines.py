"""Removal of repeated runs of lines by winnowing, in built-in DataFrame operations only.

A text is cut at line feeds and each line hashed. Of every ``run`` consecutive line hashes the
least is selected, the first one on a tie; these minima are the fingerprints, and only they go on,
each with the hashes of the ``run - 1`` lines to both sides. A run of that many lines which occurs
twice has the same fingerprint at both places. Positions are joined by fingerprint: each meets the
first position of its fingerprint, one row, however many there are. From there the match is
extended both ways, line by line; windows of ``run`` lines within the match occurred earlier.
Windows that the first position does not have in common are joined once more, by fingerprint and
lines, with the first position that has them. The union of a text's later windows is deleted, so
the first occurrence of every run stays, in the order of doc_id and position.

Defined cases: a null text is the empty text, which has one empty line. A text with fewer lines
than a run loses none. Rows with a null doc_id come last. Rows that share id and text are one
document and get the same result; others that share the id are in the order of their keys, 120 bits
of a SHA-256. A line is told by a 64-bit hash, so a window by ``run`` of them. A very long text is a
row for each of its minima; one very long line is a single hash. An empty table gives an empty
result; other columns are kept by ``remove_runs``, whose own new columns are named apart from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedTable, fresh, row_key, whole_text, with_key

#: Lines of the shortest run that is removed.
RUN = 2
LAST_ID = (1 << 63) - 1
DOC = ["id", "k0", "k1"]
PLACE = [*DOC, "p"]


def minima(docs: DataFrame, id_col: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """PLACE and fingerprint f of each selected line, near (the hashes of the lines around it, null beyond
    the text, itself in the middle) and at (how many lines before it the windows begin whose minimum it is)."""
    hashed = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("id"),
        *row_key(id_col, text),
        F.transform(F.split(whole_text(text), "\n"), lambda x: F.xxhash64(x)).alias("h"),
    )
    around = F.transform(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.array(*(F.get("h", i + j) for j in range(1 - run, run))))
    near = hashed.where(F.size("h") >= run).select(*DOC, F.posexplode(around).alias("p", "near"))

    def least(before: Column) -> Column:
        window = F.slice("near", F.lit(run) - before, F.lit(run))
        whole = F.get("near", run - 1 - before).isNotNull() & F.get("near", 2 * run - 2 - before).isNotNull()
        return whole & (F.array_position(window, F.array_min(window)) == before + 1)

    selected = near.withColumn("at", F.filter(F.array(*(F.lit(i) for i in range(run))), least)).where(F.size("at") > 0)
    return selected.select(*PLACE, F.get("near", F.lit(run - 1)).alias("f"), "near", "at")


def later_windows(selected: DataFrame, run: int = RUN) -> DataFrame:
    """DOC and s, the first line of each window that occurred before."""
    place = F.struct(*PLACE)
    first = selected.groupBy("f").agg(F.min(F.struct(*PLACE, "near")).alias("first"), F.count(F.lit(1)).alias("met"))
    first = SharedTable(first.where("met > 1").select("f", F.struct(*(F.col(f"first.{c}") for c in PLACE)).alias("first"), F.col("first.near").alias("other")), "first-positions").df
    met = selected.join(first, "f").where(place != F.col("first"))

    def reach(side: Column) -> Column:
        """How many lines from the fingerprint on are equal without a gap."""
        return F.aggregate(side, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, equal: F.struct((s["n"] + (s["on"] & equal).cast("int")).alias("n"), (s["on"] & equal).alias("on")))["n"]

    equal = F.zip_with("near", "other", lambda a, b: F.coalesce(a == b, F.lit(False)))
    matched = met.withColumn("equal", equal).withColumns({"left": reach(F.reverse(F.slice("equal", 1, run - 1))) if run > 1 else F.lit(0), "right": reach(F.slice("equal", run + 1, run - 1)) if run > 1 else F.lit(0)})
    inside = lambda b: (b <= F.col("left")) & (F.lit(run - 1) - b <= F.col("right"))
    matched = matched.select(*PLACE, "f", "near", F.filter("at", inside).alias("hit"), F.filter("at", lambda b: ~inside(b)).alias("open"))
    matched = SharedTable(matched, "matches").df
    at_once = matched.select(*DOC, "p", F.explode("hit").alias("b"))

    rest = matched.select(*PLACE, F.explode("open").alias("b"), "near").select(*PLACE, "b", F.slice("near", F.lit(run) - F.col("b"), F.lit(run)).alias("lines"))
    rest = rest.withColumns({"w0": F.xxhash64("lines"), "w1": F.xxhash64(F.lit(1), F.reverse("lines"))}).drop("lines")
    own = rest.groupBy("w0", "w1", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("met")).where("met > 1").drop("met")
    own = SharedTable(own, "first-windows").df
    in_turn = rest.join(own, ["w0", "w1", "b"]).where(place != F.col("first")).select(*DOC, "p", "b")
    return at_once.unionByName(in_turn).select(*DOC, (F.col("p") - F.col("b")).alias("s")).distinct()


def runs(later: DataFrame, run: int = RUN) -> DataFrame:
    """k0, k1, starts, ends of the maximal runs of lines to delete, in order; within one document each."""
    text = Window.partitionBy("k0", "k1").orderBy("s")
    new = F.coalesce((F.col("s") - F.lag("s").over(text) > run).cast("int"), F.lit(1))
    islands = later.withColumn("new", new).withColumn("island", F.sum("new").over(text))
    spans = islands.groupBy("k0", "k1", "island").agg(F.min("s").alias("start"), (F.max("s") + run).alias("end"))
    return spans.groupBy("k0", "k1").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("x")).select("k0", "k1", F.col("x.start").alias("starts"), F.col("x.end").alias("ends"))


NEW = ("kept_text", "n_lines", "n_removed", "n_runs")


def remove_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """The rows of ``docs`` with kept_text, n_lines, n_removed, n_runs added; a name that ``docs`` has gets a ``_``."""
    selected = SharedTable(minima(docs, id_col, text, run), "line-minima")
    found = SharedTable(runs(later_windows(selected.df, run), run), "line-runs").df
    selected.drop()
    keyed, keys = with_key(docs, id_col, text)
    lines, starts, ends, low, high = fresh(keyed, "_lines", "_starts", "_ends", "_from", "_to")
    # The same plan at every size: what is found grows with the documents and is never broadcast.
    found = found.select(F.col("k0").alias(keys[0]), F.col("k1").alias(keys[1]), F.col("starts").alias(starts), F.col("ends").alias(ends))
    joined = keyed.join(found.hint("merge"), keys, "left")
    none = F.array().cast("array<int>")
    joined = joined.withColumns({lines: F.split(whole_text(text), "\n"), starts: F.coalesce(starts, none), ends: F.coalesce(ends, none)})
    joined = joined.withColumns({low: F.concat(F.array(F.lit(0)), F.col(ends)), high: F.concat(F.col(starts), F.array(F.size(lines)))})
    kept = F.flatten(F.transform(F.arrays_zip(F.col(low).alias("a"), F.col(high).alias("z")), lambda x: F.slice(lines, x["a"] + 1, x["z"] - x["a"])))
    removed = F.aggregate(F.zip_with(ends, starts, lambda e, s: e - s), F.lit(0), lambda a, x: a + x)
    made = (F.array_join(kept, "\n"), F.size(lines), removed, F.size(starts))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), *(c.alias(n) for c, n in zip(made, fresh(docs, *NEW))))


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept_sha256."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    out = remove_runs(narrow, run=run)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))

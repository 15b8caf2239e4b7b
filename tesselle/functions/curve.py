"""Tile ids along a Hilbert curve: ids of zoom z begin behind those of all lower zooms.

``tile_id`` is one Column of shifts, masks and look-ups in a constant array, which compile into
generated code. The curve is a state machine over the bits of x and y: a state says whether the two
are swapped and whether they are inverted, and each pair of bits gives two bits of the position and
the next state. The array holds the outcome for four pairs at a time, so an id takes seven look-ups,
each of which names the one before it once: the expression stays small under filters and joins.
``tile_zxy`` is the inverse.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the highest zoom that has ids.
MAX_ZOOM = 26

#: Pairs of bits that a look-up takes, and look-ups of an id.
PAIRS, STEPS = 4, 7


def _machine() -> np.ndarray:
    """By state, PAIRS bits of x and of y: the next state, and 2 * PAIRS bits of the position below it."""
    out = np.zeros(1 << (2 + 2 * PAIRS), np.int32)
    for at in range(len(out)):
        swapped, inverted = at >> (2 * PAIRS + 1), (at >> (2 * PAIRS)) & 1
        position = 0
        for bit in range(PAIRS - 1, -1, -1):
            x, y = ((at >> (PAIRS + bit)) & 1) ^ inverted, ((at >> bit) & 1) ^ inverted
            if swapped:
                x, y = y, x
            position = position << 2 | ((3 * x) ^ y)
            if y == 0:
                swapped, inverted = swapped ^ 1, inverted ^ x
        out[at] = (swapped << 1 | inverted) << (2 * PAIRS) | position
    return out


MACHINE = _machine()


def zoom_base(z: Column) -> Column:
    """Number of tiles of all zooms below z: (4^z - 1) / 3."""
    return F.call_function("div", F.call_function("shiftleft", F.lit(1).cast("long"), (2 * z).cast("int")) - 1, F.lit(3))


def in_bounds(z: Column, x: Column, y: Column) -> Column:
    """Whether z has ids and x and y lie within it; null counts as out of bounds."""
    side = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.greatest(z, F.lit(0)), F.lit(MAX_ZOOM)).cast("int"))
    return F.coalesce(z.between(0, MAX_ZOOM) & (x >= 0) & (x < side) & (y >= 0) & (y < side), F.lit(False))


def curve_distance(z: Column, x: Column, y: Column) -> Column:
    """Position of (x, y) on the curve of zoom z, for coordinates within its bounds."""
    machine, bits = F.lit(MACHINE), PAIRS * STEPS
    left, right = (lambda v, n: F.call_function("shiftleft", v, n)), (lambda v, n: F.call_function("shiftrightunsigned", v, n))
    spare = F.lit(bits) - z.cast("int")
    x, y = (left(v.cast("long"), spare) for v in (x, y))  # the first bit that counts leads
    state, position = F.lit(0), F.lit(0).cast("long")
    for step in range(STEPS):
        low = bits - PAIRS * (step + 1)
        pairs = [right(v, F.lit(low)).bitwiseAND(F.lit((1 << PAIRS) - 1)).cast("int") for v in (x, y)]
        at = state.bitwiseOR(left(pairs[0], F.lit(PAIRS))).bitwiseOR(pairs[1])
        found = F.get(machine, at)
        position = position.bitwiseOR(left(found.bitwiseAND(F.lit((1 << 2 * PAIRS) - 1)).cast("long"), F.lit(2 * low)))
        state = found.bitwiseAND(F.lit(3 << 2 * PAIRS))
    return right(position, 2 * spare)


def tile_id(z: Column, x: Column, y: Column) -> Column:
    """The id of a tile; null out of bounds."""
    return F.when(in_bounds(z, x, y), zoom_base(z) + curve_distance(z, x, y))


def with_tile_id(df: DataFrame, z: str = "z", x: str = "x", y: str = "y", out: str = "tile_id") -> DataFrame:
    """``df`` with the id of each tile, null out of bounds."""
    return df.withColumn(out, tile_id(F.col(z), F.col(x), F.col(y)))


def tile_zxy(tile: Column) -> Column:
    """struct<z, x, y> of an id; null for a negative id or one behind the highest zoom."""
    zoom = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_ZOOM)), F.lit(0), lambda z, n: F.when(tile >= zoom_base(n), n).otherwise(z))

    def step(state: Column, bit: Column) -> Column:
        pair = F.call_function("shiftright", state["d"], bit * 2)
        rx = F.call_function("shiftright", pair, F.lit(1)).bitwiseAND(F.lit(1))
        ry = pair.bitwiseXOR(rx).bitwiseAND(F.lit(1))
        side = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        turned = (ry == 0) & (rx == 1)
        ax = F.when(turned, side - 1 - state["x"]).otherwise(state["x"])
        ay = F.when(turned, side - 1 - state["y"]).otherwise(state["y"])
        return F.struct(
            (F.when(ry == 0, ay).otherwise(ax) + side * rx).alias("x"),
            (F.when(ry == 0, ax).otherwise(ay) + side * ry).alias("y"),
            state["d"].alias("d"),
            state["z"].alias("z"),
        )

    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), (tile - zoom_base(zoom)).alias("d"), zoom.alias("z"))
    bits = F.when(zoom > 0, F.sequence(F.lit(0), zoom - 1)).otherwise(F.array().cast("array<int>"))
    found = F.aggregate(bits, start, step, lambda s: F.struct(s["z"].alias("z"), s["x"].alias("x"), s["y"].alias("y")))
    return F.when((tile >= 0) & (tile < zoom_base(F.lit(MAX_ZOOM + 1))), found)

"""Kernels over grey tiles kept as arrays of doubles, row by row; the border is mirrored without its edge pixel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(tile: Column, y: Column, x: Column, side: int) -> Column:
    def mirror(k: Column) -> Column:
        return F.when(k < 0, -k).when(k >= side, 2 * side - 2 - k).otherwise(k)

    return F.element_at(tile, (mirror(y) * side + mirror(x) + 1).cast("int"))


def _each(tile: Column, side: int, f) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: f(F.floor(i / side).cast("int"), i % side))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def contrast(values: Column) -> Column:
    """Population standard deviation."""
    return F.sqrt(F.greatest(F.lit(0.0), mean(F.transform(values, lambda x: x * x)) - F.pow(mean(values), 2)))


def laplacian(tile: Column, side: int) -> Column:
    return _each(tile, side, lambda y, x: _at(tile, y - 1, x, side) + _at(tile, y + 1, x, side) + _at(tile, y, x - 1, side) + _at(tile, y, x + 1, side) - 4 * _at(tile, y, x, side))


def gradient(tile: Column, side: int) -> Column:
    """Magnitude of the 3x3 Sobel gradient at each pixel."""
    def one(y: Column, x: Column) -> Column:
        def p(dy: int, dx: int) -> Column:
            return _at(tile, y + dy, x + dx, side)

        gx = p(-1, 1) + 2 * p(0, 1) + p(1, 1) - p(-1, -1) - 2 * p(0, -1) - p(1, -1)
        gy = p(1, -1) + 2 * p(1, 0) + p(1, 1) - p(-1, -1) - 2 * p(-1, 0) - p(-1, 1)
        return F.sqrt(gx * gx + gy * gy)

    return _each(tile, side, one)


def difference_bits(tile: Column, side: int) -> Column:
    """'1' where a pixel is brighter than its left neighbour, row by row: side x (side - 1) characters."""
    return F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: i % side < side - 1), lambda i: F.when(F.element_at(tile, i + 2) > F.element_at(tile, i + 1), "1").otherwise("0")), "")


def bits_hex(bits: Column) -> Column:
    """Hex digits of a text of '0' and '1', four a digit, the first bit highest."""
    groups = F.sequence(F.lit(0), F.floor((F.length(bits) - 1) / 4).cast("int"))
    return F.lower(F.array_join(F.transform(groups, lambda i: F.conv(bits.substr(i * 4 + 1, F.lit(4)), 2, 16)), ""))


def sign_hash(tile: Column) -> Column:
    """16 hex digits: the sign bits of 64 values."""
    def digit(k: int) -> Column:
        bits = [F.when(F.element_at(tile, 4 * k + j + 1) > 0, 8 >> j).otherwise(0) for j in range(4)]
        return F.lower(F.hex(bits[0] + bits[1] + bits[2] + bits[3]))

    return F.concat(*(digit(k) for k in range(16)))


def share(values: Column, test) -> Column:
    return F.size(F.filter(values, test)) / F.size(values)


def quantile(values: Column, q: float) -> Column:
    """With linear interpolation."""
    s, place = F.array_sort(values), (F.size(values) - 1) * F.lit(q)
    low = F.floor(place).cast("int")
    return F.element_at(s, low + 1) + (place - low) * (F.element_at(s, F.least(low + 2, F.size(values))) - F.element_at(s, low + 1))


def mean_difference(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def _boxes(size: int, parts: int) -> list[list[tuple[int, float]]]:
    """For each of `parts` equal boxes over `size` pixels: the pixels it covers, and the share of the box that each fills."""
    out = []
    for k in range(parts):
        low, high = k * size / parts, (k + 1) * size / parts
        out.append([(i, (min(i + 1, high) - max(i, low)) * parts / size) for i in range(int(low), min(size, int(high) + 1)) if min(i + 1, high) > max(i, low)])
    return out


def area_resized(tile: Column, width: int, height: int, columns: int, rows: int) -> Column:
    """A tile of width x height pixels averaged over columns x rows boxes, which may cut pixels: first along its rows, then
    across them, so each output costs the pixels of two strips and not of a box."""
    across = lambda r: F.array(*(sum((F.element_at(tile, (r * width + i + 1).cast("int")) * F.lit(w) for i, w in box), F.lit(0.0)) for box in _boxes(width, columns)))
    strips = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), across)
    whole = lambda s: F.array(*(sum((F.element_at(F.element_at(s, j + 1), k + 1) * F.lit(w) for j, w in box), F.lit(0.0)) for box in _boxes(height, rows) for k in range(columns)))
    return F.element_at(F.transform(F.array(strips), whole), 1)


def difference_hash(tile: Column, width: int, height: int) -> Column:
    """16 hex digits: whether each pixel of the tile at 9 x 8 is brighter than the one to its left, row by row."""
    small = area_resized(tile, width, height, 9, 8)
    bit = lambda s: F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(71)), lambda i: i % 9 < 8), lambda i: F.when(F.element_at(s, i + 2) > F.element_at(s, i + 1), "1").otherwise("0")), "")
    return bits_hex(F.element_at(F.transform(F.array(small), bit), 1))


def level_edges(tile: Column, width: int, height: int, least: float) -> Column:
    """(x, y) of inner pixels where brightness changes most from above to below: the vertical gradient is `least` or more, and
    not less than that of the pixels above and below."""
    def gradient(i: Column) -> Column:
        p = lambda d: F.element_at(tile, (i + d + 1).cast("int"))
        x, y = i % width, F.floor(i / width)
        inner = (x > 0) & (x < width - 1) & (y > 0) & (y < height - 1)
        return F.when(inner, F.abs(p(width - 1) + 2 * p(width) + p(width + 1) - p(-width - 1) - 2 * p(-width) - p(1 - width))).otherwise(0.0)

    places = F.sequence(F.lit(0), F.lit(width * height - 1))

    def strongest(g: Column) -> Column:
        at = lambda i: F.element_at(g, (i + 1).cast("int"))
        kept = F.filter(F.sequence(F.lit(width), F.lit(width * (height - 1) - 1)), lambda i: (at(i) >= least) & (at(i) > at(i - width)) & (at(i) >= at(i + width)))
        return F.transform(kept, lambda i: F.struct((i % width).cast("int").alias("x"), F.floor(i / width).cast("int").alias("y")))

    return F.element_at(F.transform(F.array(F.transform(places, gradient)), strongest), 1)

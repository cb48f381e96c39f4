"""Checks and choices around rendered images: tones, candidates, sizes, crops, slopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions import tiles
from framewise.operators.ranking import safe_inset


def finite(value: Column) -> Column:
    """The value, null where it is no finite number."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def learned_score(raw: Column) -> Column:
    """A raw score in [0, 1] as 0 to 10."""
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), raw * 10.0))


def tone_cost(levels: list[Column], target: list[Column], near_white: Column, allowed: Column) -> Column:
    """Distance of three luma percentiles from their targets (log ratio with 8 added, the middle thrice) and four times
    the near-white share beyond what is allowed."""
    weights = (1.0, 3.0, 1.0)
    ratio = sum((w * F.abs(F.ln((a + 8) / (b + 8))) for w, a, b in zip(weights, levels, target, strict=True)), F.lit(0.0))
    return ratio / sum(weights) + 4.0 * F.greatest(F.lit(0.0), near_white - allowed)


def best_candidate(df: DataFrame, *, by: list[str], cost: str, order: str, gain: float = 0.03) -> DataFrame:
    """(by, order, cost): the cheapest candidate, the first of equals; the neutral one (order 0) unless `gain` is saved.
    A group holds a handful of candidates."""
    both = df.groupBy(*by).agg(F.min(F.struct(F.col(cost), F.col(order))).alias("b"), F.min(F.when(F.col(order) == 0, F.col(cost))).alias("n"))
    better = F.coalesce(F.col("n") - F.col("b")[cost] >= gain, F.lit(True))
    return both.select(*by, F.when(better, F.col("b")[order]).otherwise(F.lit(0)).alias(order), F.when(better, F.col("b")[cost]).otherwise(F.col("n")).alias(cost))


def plausible_size(width: Column, height: Column, base_width: Column, base_height: Column, has_crop: Column, crop_area: Column) -> Column:
    """Whether a render has at least half the area that its crop, or the whole base, leads one to expect."""
    share = (width * height) / F.greatest(F.lit(1), base_width * base_height)
    return share >= 0.5 * F.when(has_crop, crop_area).otherwise(F.lit(1.0))


def transport_size(width: Column, height: Column, size: Column, pixels: int = 4_000_000, edge: int = 2560, most: int = 4 << 20) -> tuple[Column, Column]:
    """Width and height of an image that is sent: as it is if it keeps all three bounds, else scaled into the first two."""
    fits = (width * height <= pixels) & (F.greatest(width, height) <= edge) & (size <= most)
    scale = F.least(F.lit(1.0), edge / F.greatest(width, height), F.sqrt(pixels / (width * height)))
    return tuple(F.when(fits, x).otherwise(F.greatest(F.lit(1), F.floor(x * scale))).cast("int") for x in (width, height))


def crop_plan(width: Column, height: Column, left: Column, top: Column, right: Column, bottom: Column, degrees: Column) -> Column:
    """The crop in pixels (x, y, width, height to 6 places): cut to what a rotation leaves filled.

    An empty rectangle, a full frame under a rotation, and one that keeps under a tenth of the image raise.
    """
    inside_w, inside_h = safe_inset(width, height, degrees)
    fx, fy = (1 - inside_w / width) / 2, (1 - inside_h / height) / 2
    turned = degrees != 0
    low = lambda v, f: F.when(turned, F.greatest(v, f)).otherwise(v)
    high = lambda v, f: F.when(turned, F.least(v, 1 - f)).otherwise(v)
    l, t, r, b = low(left, fx), low(top, fy), high(right, fx), high(bottom, fy)
    full = (left == 0) & (top == 0) & (right == 1) & (bottom == 1)
    fault = F.when((left >= right) | (top >= bottom), "the rectangle is empty").when(turned & full, "a rotation needs a crop").when((l >= r) | (t >= b), "crop and rotation leave no area").when((r - l) * (b - t) < 0.1, "the crop keeps under a tenth")
    told = F.struct(F.round(l * width, 6).alias("x"), F.round(t * height, 6).alias("y"), F.round((r - l) * width, 6).alias("width"), F.round((b - t) * height, 6).alias("height"))
    return F.when(fault.isNotNull(), F.raise_error(fault).cast("struct<x:double,y:double,width:double,height:double>")).otherwise(told)


def near_level_lines(df: DataFrame, *, by: list[str], tile: str, width: int, height: int, edge: float, votes: int, most: float = 10.0, steps: int = 10) -> DataFrame:
    """(by, angle, weight): straight edges of grey tiles within `most` degrees of level, clockwise positive, by Hough voting.

    Every edge pixel votes for the lines through it at all angles in steps of 1/steps degree; a line is an angle and its
    distance from the middle of the tile, in whole pixels. A distance stands for the angles that most pixels vote for
    (their mean), and is a line if these are `votes` or more and no distance within two pixels has more (of equals the least
    stands). weight is the number of votes. Votes are counted before they are shuffled: an image sends its bins, not its votes.
    """
    n = round(most * steps)
    pixels = df.select(*by, F.explode(tiles.level_edges(F.col(tile), width, height, edge)).alias("e"))
    voted = pixels.select(*by, "e", F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("a"))
    a = F.radians(F.col("a") / steps)
    rho = F.round((F.col("e.y") - height // 2) * F.cos(a) - (F.col("e.x") - width // 2) * F.sin(a)).cast("int")
    bins = voted.groupBy(*by, rho.alias("rho"), "a").agg(F.count("*").alias("v")).where(F.col("v") >= votes)
    best = bins.groupBy(*by, "rho", "v").agg(F.avg("a").alias("a")).groupBy(*by, "rho").agg(F.max(F.struct("v", "a")).alias("b"))
    w = Window.partitionBy(*by).orderBy("rho")
    before, after = (F.coalesce(F.max("b.v").over(w.rangeBetween(*r)), F.lit(0)) for r in ((-2, -1), (1, 2)))
    return best.select(*by, "b", before.alias("before"), after.alias("after")).where("b.v > before and b.v >= after").select(*by, (F.col("b.a") / steps).alias("angle"), F.col("b.v").cast("double").alias("weight"))


def level_evidence(lines: DataFrame, *, by: list[str], angle: str, weight: str, most: float = 10.0, near: float = 0.6, least: int = 3) -> DataFrame:
    """(by, lines, slope, agreement): the weighted median of the angles within `most` degrees, and the weight within
    `near` of it; both null under `least` lines. Windows run image by image."""
    some = lines.where(F.abs(angle) <= most)
    w = Window.partitionBy(*by)
    upto = F.sum(weight).over(w.orderBy(angle).rowsBetween(Window.unboundedPreceding, 0))
    placed = some.withColumn("_u", upto).withColumn("_t", F.sum(weight).over(w))
    placed = placed.withColumn("_m", F.min(F.when(F.col("_u") >= F.col("_t") / 2, F.col(angle))).over(w))
    told = placed.groupBy(*by).agg(F.count("*").alias("lines"), F.first("_m").alias("m"), (F.sum(F.when(F.abs(F.col(angle) - F.col("_m")) < near, F.col(weight)).otherwise(0.0)) / F.sum(weight)).alias("a"))
    enough = F.col("lines") >= least
    return told.select(*by, "lines", F.when(enough, F.round("m", 2)).alias("slope"), F.when(enough, F.round("a", 3)).alias("agreement"))


def metric_bundle(tile: Column, side: int, learned: dict[str, Column]) -> Column:
    """Sharpness, tone and learned scores of a grey tile as one struct; learned scores that are not finite are null."""
    return F.struct(
        F.pow(tiles.contrast(tiles.laplacian(tile, side)), 2).alias("blur"), tiles.mean(tiles.gradient(tile, side)).alias("tenengrad"),
        tiles.mean(tile).alias("brightness"), tiles.contrast(tile).alias("contrast"), *(finite(c).alias(k) for k, c in learned.items()),
    )


def histogram_metrics(tile: Column, dark: float = 3.0, bright: float = 252.0) -> Column:
    """Mean (3 places), and shares (6 places) of values up to `dark` and from `bright` on."""
    return F.struct(F.round(tiles.mean(tile), 3).alias("mean_luma"), F.round(tiles.share(tile, lambda x: x <= dark), 6).alias("shadow_clip"), F.round(tiles.share(tile, lambda x: x >= bright), 6).alias("highlight_clip"))


def corners(tile: Column, side: int) -> Column:
    """Mean of the four corner squares of an eighth of the side: top left, top right, bottom left, bottom right."""
    e = max(1, side // 8)

    def square(y: int, x: int) -> Column:
        return tiles.mean(F.filter(tile, lambda v, i: (F.floor(i / side) >= y) & (F.floor(i / side) < y + e) & (i % side >= x) & (i % side < x + e)))

    return F.array(*(F.round(square(y, x), 2) for y in (0, side - e) for x in (0, side - e)))


def edges(tile: Column, side: int, dark: float = 3.0, solid: float = 0.98) -> Column:
    """Share of dark pixels (4 places) on each outer edge, and whether one is all but solid."""
    on = {"top": lambda i: i < side, "bottom": lambda i: i >= side * (side - 1), "left": lambda i: i % side == 0, "right": lambda i: i % side == side - 1}
    part = {k: tiles.share(_where(tile, f), lambda x: x <= dark) for k, f in on.items()}
    any_ = F.greatest(*part.values()) >= solid
    return F.struct(*(F.round(c, 4).alias(k) for k, c in part.items()), any_.alias("solid"))


def _where(tile: Column, test) -> Column:
    return F.filter(tile, lambda v, i: test(i))

import math
import random

from pyspark.sql import functions as F

from framewise.functions import tiles
from framewise.operators import render


def boxes(tile, w, h, ow, oh):
    out = []
    for y in range(oh):
        for x in range(ow):
            total = 0.0
            for j in range(h):
                for i in range(w):
                    a = max(0.0, min(i + 1, (x + 1) * w / ow) - max(i, x * w / ow))
                    b = max(0.0, min(j + 1, (y + 1) * h / oh) - max(j, y * h / oh))
                    total += tile[j * w + i] * a * b
            out.append(total * ow * oh / w / h)
    return out


def test_area_resize_and_hash(spark):
    rng = random.Random(1)
    for w, h in ((8, 8), (9, 8), (20, 13), (18, 16)):
        tile = [float(rng.randint(0, 255)) for _ in range(w * h)]
        df = spark.createDataFrame([(tile,)], "t array<double>")
        got = df.select(tiles.area_resized(F.col("t"), w, h, 9, 8).alias("s"), tiles.difference_hash(F.col("t"), w, h).alias("d")).first()
        want = boxes(tile, w, h, 9, 8)
        assert max(abs(a - b) for a, b in zip(got.s, want, strict=True)) < 1e-9
        bits = "".join("1" if want[9 * y + x + 1] > want[9 * y + x] else "0" for y in range(8) for x in range(8))
        assert got.d == f"{int(bits, 2):016x}"


def test_lines_of_known_slope(spark):
    w, h = 160, 120
    rows = []
    for slope in (-7.0, -0.4, 0.0, 3.3, 9.0):
        t = math.tan(math.radians(slope))
        tile = [60.0 * sum(y > offset + (x - w / 2) * t for offset in (25, 60, 95)) for y in range(h) for x in range(w)]
        rows.append((slope, tile))
    rows.append((99.0, [0.0] * (w * h)))  # nothing to see
    df = spark.createDataFrame(rows, "slope double, tile array<double>")
    lines = render.near_level_lines(df, by=["slope"], tile="tile", width=w, height=h, edge=100.0, votes=60)
    found = {}
    for r in lines.collect():
        found.setdefault(r.slope, []).append(r.angle)
    assert set(found) == {-7.0, -0.4, 0.0, 3.3, 9.0}
    assert all(len(a) == 3 and max(abs(x - s) for x in a) < 0.6 for s, a in found.items())
    told = {r.slope: (r.m, r.agreement) for r in render.level_evidence(lines.withColumnRenamed("slope", "k"), by=["k"], angle="angle", weight="weight").select(F.col("k").alias("slope"), F.col("slope").alias("m"), "agreement").collect()}
    assert all(abs(m - s) < 0.6 and a == 1.0 for s, (m, a) in told.items())

"""Plain-Python geometry and small random inputs to test the Spark operators against."""

import math
import random

from pyspark.sql import Row

RINGS = "array<array<struct<x:double,y:double>>>"


def quarter(v):
    """Round to quarters, so that double arithmetic on the result is exact."""
    return round(v * 4) / 4


def star(rng, cx, cy, radius, n):
    """Closed ring of a star-shaped polygon."""
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    pts = [(quarter(cx + rng.uniform(0.3, 1) * radius * math.cos(a)),
            quarter(cy + rng.uniform(0.3, 1) * radius * math.sin(a))) for a in angles]
    return pts + pts[:1]


def random_polygons(seed, count, span, radius, offset=(0.0, 0.0)):
    rng = random.Random(seed)
    out = []
    for fid in range(count):
        cx, cy = offset[0] + rng.uniform(0, span), offset[1] - rng.uniform(0, span)
        r = rng.uniform(radius / 4, radius)
        rings = [star(rng, cx, cy, r, rng.randint(3, 9))]
        if rng.random() < 0.3:  # a second part well away from the first
            rings.append(star(rng, cx + 3 * radius, cy, r / 2, 5))
        if rng.random() < 0.3:  # a box with a hole
            b = quarter(r)
            h = quarter(r / 3)
            cx, cy = quarter(cx), quarter(cy)
            rings = [[(cx - s, cy - s), (cx + s, cy - s), (cx + s, cy + s), (cx - s, cy + s), (cx - s, cy - s)]
                     for s in (b, h) if s > 0]
        out.append((fid, rings))
    return out


def features_frame(spark, polygons, **attrs):
    rows = [(fid, [[Row(x=float(x), y=float(y)) for x, y in ring] for ring in rings], {k: f(fid) for k, f in attrs.items()})
            for fid, rings in polygons]
    return spark.createDataFrame(rows, f"fid bigint, rings {RINGS}, attrs map<string,string>")


def edges(rings):
    return [(p, q) for ring in rings for p, q in zip(ring, ring[1:])]


def inside(pt, rings):
    x, y = pt
    odd = False
    for (x1, y1), (x2, y2) in edges(rings):
        if (y1 > y) != (y2 > y):
            cross = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
            if (cross > 0) if y2 > y1 else (cross < 0):
                odd = not odd
    return odd


def side(p, q, r):
    v = (q[0] - p[0]) * (r[1] - p[1]) - (r[0] - p[0]) * (q[1] - p[1])
    return (v > 0) - (v < 0)


def edge_meets_box(p, q, box):
    xmin, ymin, xmax, ymax = box
    if max(p[0], q[0]) < xmin or min(p[0], q[0]) > xmax or max(p[1], q[1]) < ymin or min(p[1], q[1]) > ymax:
        return False
    s = [side(p, q, c) for c in ((xmin, ymin), (xmin, ymax), (xmax, ymin), (xmax, ymax))]
    return min(s) <= 0 <= max(s)


def meets_box(rings, box):
    if any(edge_meets_box(p, q, box) for p, q in edges(rings)):
        return True
    return inside((box[0], box[1]), rings)


def segments_meet(p, q, r, s):
    if max(p[0], q[0]) < min(r[0], s[0]) or max(r[0], s[0]) < min(p[0], q[0]):
        return False
    if max(p[1], q[1]) < min(r[1], s[1]) or max(r[1], s[1]) < min(p[1], q[1]):
        return False
    return side(p, q, r) * side(p, q, s) <= 0 and side(r, s, p) * side(r, s, q) <= 0


def polygons_meet(a, b):
    if any(segments_meet(p, q, r, s) for p, q in edges(a) for r, s in edges(b)):
        return True
    return any(inside(r[0], b) for r in a) or any(inside(r[0], a) for r in b)


def tile_rows(uid, x0, y0, w, h, cols, rows):
    return [(uid, c, r, float(x0 + c * w), float(y0 - (r + 1) * h), float(x0 + (c + 1) * w), float(y0 - r * h),
             float(x0), float(y0), float(w), float(h)) for c in range(cols) for r in range(rows)]


TILE_SCHEMA = ("dataset_uid string, col int, row_ int, xmin double, ymin double, xmax double, ymax double, "
               "x0 double, y0 double, tile_w double, tile_h double")

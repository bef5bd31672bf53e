"""Nearest segments by split cells against a plain scan of all segments."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import quadtree, shapes


def nearest(x, y, segs):
    best = None
    for shape, no, x0, y0, x1, y1, cum, length in segs:
        dx, dy = x1 - x0, y1 - y0
        f = min(1.0, max(0.0, ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy))) if length else 0.0
        d = round(math.hypot(x - x0 - f * dx, y - y0 - f * dy) * 1e6) / 1e6
        if best is None or (d, shape, no) < best[:3]:
            best = (d, shape, no, cum + f * length)
    return best


def network(seed, lines=25):
    rng, segs = random.Random(seed), []
    for k in range(lines):
        x, y, cum = rng.uniform(0, 9000), rng.uniform(0, 9000), 0.0
        for no in range(rng.randint(1, 40)):
            nx, ny = x + rng.uniform(-200, 400), y + rng.uniform(-400, 200)
            length = math.hypot(nx - x, ny - y)
            segs.append((f"s{k:02d}", no, x, y, nx, ny, cum, length))
            x, y, cum = nx, ny, cum + length
    segs += [(f"t{k}", *s[1:]) for k in range(30) for s in segs[:3]]  # many lines on one street
    return segs + [("z", 0, 500.0, 500.0, 500.0, 500.0, 0.0, 0.0)]


SEGS = "shape_id string, seg_no int, x0 double, y0 double, x1 double, y1 double, cum_m double, len_m double"


@pytest.mark.parametrize("short", [16, 3])
def test_lists_hold_the_nearest_at_any_distance(spark, short):
    segs, rng = network(1), random.Random(2)
    spots = [(rng.uniform(-500, 9500), rng.uniform(-500, 9500)) for _ in range(150)] + [(s[2], s[3]) for s in segs[:10]]
    spots += [(2e6, -3e6), (-4e7, 1e7), (9000.0, 9e5), (32.0, 64.0)] + [(rng.gauss(1000, 5), rng.gauss(1000, 5)) for _ in range(40)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)] + [(9999, None, 1.0), (9998, math.nan, 1.0)], "id int, x double, y double").repartition(3)
    here = quadtree.located(points)
    lists = quadtree.segment_lists(here, spark.createDataFrame(segs, SEGS), short=short)
    got = {r.id: r for r in here.join(lists, ["_fx", "_fy"]).collect()}
    assert set(got) == set(range(len(spots)))
    most = 0
    for i, (x, y) in enumerate(spots):
        mine = [(s.shape_id, s.seg_no, s.x0, s.y0, s.x1, s.y1, s.cum_m, s.len_m) for s in got[i].segs]
        assert nearest(x, y, mine) == nearest(x, y, segs)
        most = max(most, len(mine))
    assert most < 40  # of several hundred


def test_lists_by_line(spark):
    segs, rng = network(3, 8), random.Random(4)
    points = [(i, rng.choice(segs)[0], rng.uniform(-5e4, 5e4), rng.uniform(-5e4, 5e4)) for i in range(120)] + [(500, "no such line", 1.0, 1.0)]
    here = quadtree.located(spark.createDataFrame(points, "id int, shape_id string, x double, y double"))
    lists = quadtree.segment_lists(here, spark.createDataFrame(segs, SEGS), ["shape_id"], short=4)
    got = {r.id: r for r in here.join(lists, ["shape_id", "_fx", "_fy"]).collect()}
    assert set(got) == set(range(120))
    for i, shape, x, y in points[:120]:
        mine = [(shape, s.seg_no, s.x0, s.y0, s.x1, s.y1, s.cum_m, s.len_m) for s in got[i].segs]
        assert nearest(x, y, mine) == nearest(x, y, [s for s in segs if s[0] == shape])


def test_nothing_to_be_near(spark):
    points = spark.createDataFrame([(1, -79.4, 43.7), (2, None, 43.7)], "id int, longitude double, latitude double")
    none = spark.createDataFrame([], SEGS)
    got = shapes.nearest_of_network(points, none).collect()
    assert sorted((r.id, r.nearest_shape_id) for r in got) == [(1, None), (2, None)]
    assert shapes.nearest_of_network(points.filter(F.lit(False)), spark.createDataFrame(network(1), SEGS)).count() == 0

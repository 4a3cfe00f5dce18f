"""Lines, boxes, filters and growth: goldens and naive versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pixelweave.functions import AROUND, box, box_contains, box_crossings, centre_theta, crossing, disc, edge_distance, line_distance, line_through, overlap_amount, packed, polar, polar_points, same_line, unpacked, x_at, y_at
from pixelweave.functions.tables import placed
from pixelweave.operators import group, grow, lines

PX = "frame_idx int, blob_id int, x int, y int, intensity int"


def value(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_lines(spark):
    d = lambda *v: [F.lit(float(x)) for x in v]
    assert value(spark, line_distance(*d(1, 0, -5), *d(8, 2))) == (3.0,)
    a, b, c = line_through(*d(0, 1), *d(2, 5))
    assert value(spark, y_at(a, b, c, F.lit(1.0)), x_at(a, b, c, F.lit(3.0))) == (3.0, 1.0)
    assert value(spark, y_at(*d(1, 0, -5), F.lit(1.0)), x_at(*d(0, 1, -5), F.lit(1.0))) == (None, None)
    met = crossing((a, b, c), tuple(d(1, 0, -1)))
    assert value(spark, met["x"], met["y"], crossing((a, b, c), (a, b, c))["x"]) == (1.0, 3.0, None)
    assert value(spark, same_line((a, b, c), (a, b, c + 1e-10)), same_line((a, b, c), (a, b, c + 1e-3))) == (True, False)
    for theta, rho in ((0, 7), (30, -4), (90, 12), (135, 5), (179, 0.5)):
        t, r = value(spark, *polar(*line_through(*polar_points(*d(theta, rho)))))
        assert (t % 180, abs(r)) == (pytest.approx(theta, abs=1e-6), pytest.approx(abs(rho), abs=1e-6))


def test_boxes(spark):
    b = lambda *v: tuple(F.lit(x) for x in v)
    assert value(spark, overlap_amount(b(0, 0, 5, 5), b(5, 0, 9, 5)), overlap_amount(b(0, 0, 5, 5), b(0, 0, 5, 5))) == (0.0, 1.0)
    assert value(spark, centre_theta(b(0, 0, 2, 2), b(5, 0, 7, 2)), centre_theta(b(0, 0, 2, 2), b(0, 5, 2, 7)), centre_theta(b(0, 0, 2, 2), b(5, 5, 7, 7))) == (0.0, 90.0, 135.0)
    assert value(spark, edge_distance(b(0, 0, 9, 9), b(2, 2, 4, 4)), edge_distance(b(2, 2, 4, 4), b(0, 0, 9, 9))) == (-9.0, -9.0)
    assert value(spark, edge_distance(b(0, 0, 4, 4), b(10, 0, 14, 4))) == (10.0,)  # of the sides that are near enough the last one counts
    inside = [box_contains(b(0, 0, 5, 5), F.lit(x), F.lit(y)) for x, y in ((5.9, 0.0), (6.0, 0.0), (float("nan"), 1.0), (float("inf"), 1.0))]
    assert value(spark, *inside) == (True, False, False, False)
    met = value(spark, box_crossings(b(0, 0, 10, 10), line_through(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))))[0]
    assert [(p["x"], p["y"]) for p in met] == [(10.0, 10.0), (10.0, 10.0)]  # a side's lower end isn't part of it
    assert [p[2] for p in disc(2)] == sorted(p[2] for p in disc(2)) and len(disc(2)) == 13 and disc(2)[0] == (0, 0, 0.0)


def test_channels_in_one_number(spark):
    v = [F.lit(x) for x in (1, 2, 65535, 65534)]
    assert value(spark, *unpacked(packed(*v))) == (1, 2, 65535, 65534)


def strokes(spark, *runs):
    return spark.createDataFrame([(0, g, x, y, 100) for g, places in enumerate(runs, 1) for x, y in places], PX)


def test_best_line_of_strokes(spark):
    px = strokes(spark, [(5, y) for y in range(20)], [(10 + i, i) for i in range(15)], [(3, 30), (4, 30)])
    found = {r["blob_id"]: (r["theta"], r["rho"], r["votes"]) for r in lines.best_lines(px).collect()}
    assert found[1] == (0, 5, 20) and found[2][0] == 135 and set(found) == {1, 2}
    best = lines.best_lines(px)
    fit = {r["blob_id"]: r for r in lines.line_fit(px, best).collect()}
    assert (fit[1]["f_average_line"], fit[1]["f_line_length"], fit[1]["f_max_hough"]) == (0.0, 19.0, 1.0)
    assert (fit[3]["f_average_line"], fit[3]["ideal_distance"], fit[3]["f_line_length"]) == (4294967295.0, 420420420.0, 0.0)
    fill = {r["blob_id"]: r["f_line_fill"] for r in lines.line_fill(group.statistics(px), px, best).collect()}
    assert fill[3] == 0.0 and 0.3 < fill[2] < 0.4  # one of the three places on and beside the line
    stray = px.unionByName(strokes(spark, [(9, 3)]))
    assert lines.line_trim(stray, lines.best_lines(stray)).where("x = 9 and y = 3").count() == 0
    assert lines.neighbour_trim(px).count() == 0


def grown(value, least, min_contrast):
    """Growth pixel by pixel, over a dictionary."""
    owner, n, found = {}, 0, set()
    for (x, y), own in sorted(value.items(), key=lambda p: (-p[1], p[0][1], p[0][0])):
        if (x, y) in owner:
            continue
        if own <= least or any(value.get((x + dx, y + dy), 0) > own for dx, dy in AROUND):
            owner[x, y] = 0
            continue
        n += 1
        owner[x, y], todo = n, [(x, y)]
        while todo:
            a, b = todo.pop()
            found.add((n, a, b))
            for dx, dy in AROUND:
                q = (a + dx, b + dy)
                if q in value and q not in owner:
                    joins = abs(own - value[q]) / max(own, value[q], 1) * 100 < min_contrast
                    owner[q] = n if joins else 0
                    if joins:
                        todo.append(q)
    return found


def test_growth_on_arrays_is_growth_pixel_by_pixel(spark):
    r = random.Random(11)
    for top, share in ((12, 1.0), (200, 1.0), (40, 0.6)):
        value = {(x, y): r.randint(0, top) for x in range(24) for y in range(17) if r.random() < share}
        px = spark.createDataFrame([(3, x, y, v) for (x, y), v in value.items()], "frame_idx int, x int, y int, intensity int")
        found = {(p.blob_id, p.x, p.y) for p in grow.grow_groups(px, top // 2, 40.0).collect()}
        assert found == grown(value, top // 2, 40.0) and found


def test_places_are_counted_over_ranges(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), i, r.randint(1, 5)) for i in r.sample(range(500), 300)]
    found = placed(spark.createDataFrame(rows, "k string, i int, w int").repartition(7), ["k"], ["i"], "w").collect()
    assert len(found) == 300
    for x in found:
        assert x["before"] == sum(w for k, i, w in rows if k == x["k"] and i < x["i"])


def test_boxes_of_rows(spark):
    df = spark.createDataFrame([(0, 0, 3, 3)], "min_x int, min_y int, max_x int, max_y int")
    assert df.select(box_contains(box(), F.lit(3), F.lit(0))).first()[0]
    assert list(itertools.chain(*df.select(*box()).collect())) == [0, 0, 3, 3]

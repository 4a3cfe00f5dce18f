"""Slices in order, decisions by images, nearest groups and walks against plain loops; odd rows."""

import random

import pytest

from pixelweave.operators import group, lines, review

PX = "frame_idx int, blob_id int, x int, y int, intensity int"
BOX = "frame_idx int, ord int, min_x int, min_y int, max_x int, max_y int"


def pixels(seed, frames=2, n=90, side=40):
    r = random.Random(seed)
    at = {(f, r.randrange(side), r.randrange(side)) for f in range(frames) for _ in range(n)}
    return [(f, 1 + x // 8 * 5 + y // 8, x, y, r.randint(1, 9)) for f, x, y in sorted(at)]


def boxes(seed, frames=2, n=6, side=40):
    r = random.Random(seed)
    made = [(f, o, r.randrange(side), r.randrange(side)) for f in range(frames) for o in range(1, n)]
    return [(f, o, x, y, x + r.randrange(12), y + r.randrange(12)) for f, o, x, y in made]


@pytest.mark.parametrize("seed", [1, 2])
def test_slices_one_after_the_other(spark, seed):
    px, drawn = pixels(seed), boxes(seed)
    label = {(f, x, y): b for f, b, x, y, _ in px}
    record = {0: [], 1: []}
    last = {f: max(b for g, b, *_ in px if g == f) for f in (0, 1)}
    for f, o, x0, y0, x1, y1 in sorted(drawn):
        hit = [k for k in label if k[0] == f and x0 <= k[1] <= x1 and y0 <= k[2] <= y1]
        if hit:
            last[f] += 1
            label |= dict.fromkeys(hit, last[f])
            record[f] = [s for s in record[f] if not (s[1] < x1 and x0 < s[3] and s[2] < y1 and y0 < s[4])] + [(o, x0, y0, x1, y1)]
    p, s = spark.createDataFrame(px, PX), spark.createDataFrame(drawn + drawn[:2], BOX)
    found = {(r.frame_idx, r.x, r.y): r.blob_id for r in group.razor_in_order(p, s).collect()}
    assert found == label
    kept = review.recorded_slices(s, p).collect()
    assert sorted(map(tuple, kept)) == sorted((f, *b) for f in record for b in record[f])
    # the record's boxes lie apart, so their cuts don't depend on their order
    again, back = (group.razor_in_order(p, spark.createDataFrame(kept, BOX).selectExpr("frame_idx", f"{sign} ord AS ord", *BOX.replace(" int", "").split(", ")[2:])).collect() for sign in ("+", "-"))
    parts = lambda rows: {frozenset((r.frame_idx, r.x, r.y) for r in rows if (r.frame_idx, r.blob_id) == key) for key in {(r.frame_idx, r.blob_id) for r in rows}}
    edges = {(r.x, r.y) for b in kept for r in again if r.frame_idx == b.frame_idx and (r.x in (b.min_x, b.max_x) or r.y in (b.min_y, b.max_y))}
    inner = lambda ps: {frozenset(k for k in g if k[1:] not in edges) for g in ps} - {frozenset()}
    assert inner(parts(again)) == inner(parts(back))


def test_slices_without_rows(spark):
    p, s = spark.createDataFrame(pixels(3), PX), spark.createDataFrame([(0, 1, None, 0, 9, 9), (7, 1, 0, 0, 9, 9)], BOX)
    assert sorted(map(tuple, group.razor_in_order(p, s).collect())) == sorted(pixels(3))
    assert review.recorded_slices(s, p).count() == 0 == group.razor_in_order(p.limit(0), s).count()


def test_an_image_decides_its_frame_and_scores_the_others(spark):
    px = spark.createDataFrame([(0, 1, 1, 1, 5), (0, 2, 3, 3, 5), (1, 1, 1, 1, 5), (1, 2, 3, 3, 5), (1, 3, 5, 5, 5)], PX)
    image = spark.createDataFrame([(0, 1, 1, 255), (0, 3, 3, 0)], "frame_idx int, x int, y int, value int")
    scores = spark.createDataFrame([(0, 2, 0.9), (1, 1, 0.5), (1, 2, 0.0)], "frame_idx int, blob_id int, score double")
    rows = sorted(map(tuple, review.decide(px, image, scores).collect()))
    assert rows == [(0, 1, "userSelected", 1.0, True), (0, 2, "userSelected", 0.0, False), (1, 1, "fromClassifier", 0.5, True), (1, 2, "fromClassifier", 0.0, False), (1, 3, None, None, None)]


@pytest.mark.parametrize("cell", [2, 16])
def test_nearest_group_of_any_distance(spark, cell):
    px = [*pixels(4, n=40, side=60), (2, 1, 0, 0, 1), (3, 1, 0, 0, 1), (3, 2, 900, 700, 1), (3, 3, 700, 900, 1)]
    points = [(f, b, x, y) for (f, b), (x, y) in {(f, b): (x, y) for f, b, x, y, _ in px}.items()] + [(0, 99, None, 3), (0, 98, -50, 200), (9, 1, 0, 0)]
    found = {(r.frame_idx, r.blob_id): (r.distance_sq, r.other_id) for r in group.nearest(spark.createDataFrame(points, "frame_idx int, blob_id int, x int, y int"), spark.createDataFrame(px, PX), cell).collect()}
    plain = {(f, b): min((((x - u) ** 2 + (y - v) ** 2, c) for g, c, u, v, _ in px if g == f and c != b), default=(None, None)) if x is not None else (None, None) for f, b, x, y in points}
    assert found == plain


@pytest.mark.parametrize("gap", [0, 1, 4])
def test_walks_stop(spark, gap):
    r = random.Random(gap + 1)
    rows = {(f, x, (x * (f + 1)) // 3 + (r.random() < 0.2)) for f in range(3) for x in range(36) if r.random() < 0.9}
    px = [(f, 1 + x // 12, x, y, 1) for f, x, y in sorted(rows)]
    df = spark.createDataFrame(px, PX)
    stats, best = group.statistics(df), lines.best_lines(df)
    held = {(f, x, y) for f, _, x, y, _ in px}
    box = {(s.frame_idx, s.blob_id): s for s in stats.collect()}
    plain = {}
    for b in best.collect():
        s = box[b.frame_idx, b.blob_id]
        level = abs(b.sine) > abs(b.cosine)
        start = int((s.min_x + s.max_x + 1) / 2 if level else (s.min_y + s.max_y + 1) / 2)

        def there(t, b=b, level=level):
            u = int((b.rho * 1_000_000 - t * (b.cosine if level else b.sine)) / (b.sine if level else b.cosine))
            return (b.frame_idx, t, u) in held if level else (b.frame_idx, u, t) in held

        seen = set()
        for way in (1, -1):
            t, missed = start, 0
            while missed <= gap and 0 <= t < 60:
                missed = 0 if there(t) else missed + 1
                seen |= {t} if not missed else set()
                t += way
        if seen:
            plain[b.frame_idx, b.blob_id] = (min(seen), max(seen), len(seen))
    assert {(w.frame_idx, w.blob_id): (w.first, w.last, w.hits) for w in lines.walk_until(df, stats, best, 60, 60, gap).collect()} == plain != {}

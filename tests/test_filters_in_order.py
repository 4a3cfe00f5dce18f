"""Filters that depend on order, against plain versions that go pixel by pixel over sets."""

import random
from collections import Counter

import pytest

from pixelweave.operators import filters, group, lines

PX = "frame_idx int, blob_id int, x int, y int, intensity int"


def strokes(spark, *runs):
    return spark.createDataFrame([(0, g, x, y, 100) for g, places in enumerate(runs, 1) for x, y in places], PX)


class Plain:
    """A frame as a dictionary of sets, and a raster that keeps each place's first group."""

    def __init__(self, pixels):
        self.raster = {(x, y): g for g, x, y, _ in pixels}
        self.value = {(x, y): v for _, x, y, v in pixels}
        self.groups = {g: {(x, y) for h, x, y, _ in pixels if h == g} for g in {p[0] for p in pixels}}

    def order(self):
        return [(g, set(self.groups[g])) for g in sorted(self.groups, key=lambda g: (-len(self.groups[g]), g))]

    def median(self, places):
        return sorted(self.value[p] for p in places)[len(places) // 2]

    def near(self, own, places, scan):
        xs, ys = [x for x, _ in places], [y for _, y in places]
        found = set()
        for x in range(min(xs) - scan, max(xs) + scan + 1):
            for y in range(min(ys) - scan, max(ys) + scan + 1):
                g = self.raster.get((x, y))
                if g is not None and g != own and g in self.groups:
                    found.add(g)
        return sorted(found)

    def cloud(self, own, places, scan, processed):
        queue, found = [(own, places)], []
        while queue:
            g, at = queue.pop(0)
            for o in self.near(g, at, scan):
                if o not in processed:
                    processed.add(o)
                    found.append(o)
                    queue.append((o, self.groups[o]))
        return found

    def isolated(self, scan, need, over, up_to):
        for g, places in self.order():
            if len(places) <= up_to and len([o for o in self.near(g, places, scan) if len(self.groups[o]) > over]) < need:
                self.groups.pop(g)

    def dim_isolated(self, scan, need, up_to):
        medians = sorted(self.median(p) for p in self.groups.values())
        if medians:
            half, quarter = medians[len(medians) // 2], medians[len(medians) // 4]
            for g, places in self.order():
                if len(places) <= up_to and self.median(places) <= half and len([o for o in self.near(g, places, scan) if self.median(self.groups[o]) > quarter]) < need:
                    self.groups.pop(g)

    def again(self, step, *args):
        last, n = len(self.groups), 0
        while True:
            step(*args)
            n += 1
            if len(self.groups) == last or n > 8:
                return
            last = len(self.groups)

    def disconnected(self, scan, smaller, larger, need):
        processed = set()
        for g, places in self.order():
            if g in processed:
                continue
            processed.add(g)
            if len(places) >= smaller or len(places) < larger:
                continue
            cloud = self.cloud(g, places, scan, processed)
            mean = (len(places) + sum(len(self.groups[o]) for o in cloud)) / (len(cloud) + 1)
            if len(cloud) < need and mean < smaller:
                for o in [g, *cloud]:
                    self.groups.pop(o, None)

    def line(self, places):
        votes = Counter()
        for x, y in places:
            for t, c, s in lines.angles():
                votes[t, (x * c + y * s + lines.SCALE // 2) // lines.SCALE] += 1
        trig = {t: (c, s) for t, c, s in lines.angles()}
        off = lambda t, rho: sorted(abs(x * trig[t][0] + y * trig[t][1] - rho * lines.SCALE) for x, y in places)
        top = sorted(votes, key=lambda k: (-votes[k], k))[:10]
        best = min(top, key=lambda k: off(*k)[(len(places) - 1) // 2])
        return best[1], *trig[best[0]], sum(off(*best)) / len(places) / lines.SCALE

    def connect(self, scan, smaller, border, width, height, beside):
        processed = set()
        for g, places in self.order():
            if g in processed:
                continue
            processed.add(g)
            if len(places) >= smaller:
                continue
            cloud = self.cloud(g, places, scan, processed)
            whole = set().union(*[self.groups[o] for o in cloud])
            if len(whole) < 3:
                continue
            best, n = self.line(whole), 0
            while best[3] < 50 and n <= 10 or n and n <= 10:
                hit = {self.raster[p] for p in self.walked(best, whole, border, width, height, beside) if p in self.raster} & set(self.groups)
                if len(hit) < 2:
                    break
                for o in hit:
                    whole |= self.groups.pop(o)
                self.groups[min(cloud)] = whole
                best, n = self.line(whole), n + 1

    def walked(self, best, whole, border, width, height, beside):
        rho, c, s, _ = best
        if abs(s) > abs(c):
            for x in range(max(min(p[0] for p in whole) - border, 0), min(max(p[0] for p in whole) + border, width - 1) + 1):
                y = int((rho * lines.SCALE - c * x) / s)
                yield from ((x, v) for v in range(y - beside, y + beside + 1) if y >= 0 and 0 <= v < height)
        else:
            for y in range(max(min(p[1] for p in whole) - border, 0), min(max(p[1] for p in whole) + border, height - 1) + 1):
                x = int((rho * lines.SCALE - s * y) / c)
                yield from ((v, y) for v in range(x - beside, x + beside + 1) if x >= 0 and 0 <= v < width)

    def labels(self):
        out = {}
        for g, places in sorted(self.groups.items(), key=lambda e: (len(e[1]), -e[0])):
            out |= {p: g for p in places}
        return {(g, *p) for p, g in out.items()}


def frames(n, seed):
    """Scattered groups of one to some pixels, and a broken streak."""
    r = random.Random(seed)
    for f in range(n):
        pixels, taken = [], set()
        for g in range(1, 50):
            x, y = (g * 3, g * 2 + r.randint(-1, 1)) if g % 4 == 0 else (r.randint(0, 160), r.randint(0, 110))
            for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14, 30])):
                if (x, y) not in taken:
                    taken.add((x, y))
                    pixels.append((g, x, y, r.randint(1, 400)))
                x, y = max(x + r.randint(-1, 1), 0), max(y + r.randint(-1, 1), 0)
        yield f, pixels


CASES = {
    "isolated": (filters.isolated(7, 2, 2, 14), lambda p: p.again(p.isolated, 7, 2, 2, 14)),
    "dim-isolated": (filters.dim_isolated(12, 2), lambda p: p.again(p.dim_isolated, 12, 2, 24)),
    "disconnected": (filters.disconnected(9, 18, 0, 3), lambda p: p.disconnected(9, 18, 0, 3)),
    "disconnected-from": (filters.disconnected(9, 30, 3, 4), lambda p: p.disconnected(9, 30, 3, 4)),
    "connect": (filters.connected_by_lines(8, 20, 10, 170, 120, 2), lambda p: p.connect(8, 20, 10, 170, 120, 2)),
    "connect-close": (filters.connected_by_lines(4, 31, 0, 170, 120), lambda p: p.connect(4, 31, 0, 170, 120, 5)),
}


@pytest.mark.parametrize("name", CASES)
def test_steps_are_what_plain_ones_are(spark, name):
    all_of = dict(frames(6, 5))
    px = spark.createDataFrame([(f, *p) for f, pixels in all_of.items() for p in pixels], PX)
    step, plain = CASES[name]
    found = filters.run(px, [(name, step)]).collect()
    went = 0
    for f, pixels in all_of.items():
        p = Plain(pixels)
        plain(p)
        assert {(r.blob_id, r.x, r.y) for r in found if r.frame_idx == f} == p.labels()
        went += p.groups.keys() != {q[0] for q in pixels}
    assert went > 3


def test_the_usual_steps_in_order(spark):
    """All of them on a frame, one by one over plain sets."""
    all_of = dict(frames(4, 9))
    px = spark.createDataFrame([(f, *p) for f, pixels in all_of.items() for p in pixels], PX)
    steps = filters.default_steps(1, 20, 3, 60, 170, 120)
    assert [n for n, _ in steps] == ["connect-close", "qualify", "dim-isolated", "isolated", "disconnected-small", "connect-wider", "disconnected-large", "isolated-near", "connect-last", "isolated-last", "slices"]
    found = filters.run(px, steps).collect()
    for f, pixels in all_of.items():
        p = Plain(pixels)
        p.connect(24, 80, 20, 170, 120, 5)
        p.groups = {g: s for g, s in p.groups.items() if len(s) > 1 and p.median(s) >= 20 and not (len(s) < 3 and p.median(s) < 60)}
        p.again(p.dim_isolated, 50, 2, 24)
        p.again(p.isolated, 24, 1, 6, 24)
        p.disconnected(60, 18, 0, 2)
        p.connect(30, 120, 10, 170, 120, 5)
        p.disconnected(60, 50, 18, 2)
        p.again(p.isolated, 12, 1, 0, 24)
        p.connect(20, 80, 0, 170, 120, 5)
        p.again(p.isolated, 6, 1, 0, 50)
        assert {(r.blob_id, r.x, r.y) for r in found if r.frame_idx == f} == p.labels()
    assert found


def test_groups_on_one_line_are_joined(spark):
    px = strokes(spark, [(x, 10) for x in range(0, 6)], [(x, 10) for x in range(8, 14)], [(x, 10) for x in range(40, 46)], [(30, 40), (31, 40), (30, 41)])
    sizes = lambda border: {r["blob_id"]: r["size"] for r in group.statistics(filters.run(px, [("connect", filters.connected_by_lines(4, 20, border, 100, 100, 1))])).collect()}
    # the seed, 1, isn't part of its own cloud, but lies on the line
    assert sizes(40) == {2: 18, 4: 3}
    assert sizes(0) == {1: 6, 2: 6, 3: 6, 4: 3}


def test_disconnected_clouds_go(spark):
    px = strokes(spark, [(0, 0)], [(2, 0)], [(4, 0)], [(50, 50)], [(52, 50)], [(x, 80) for x in range(30)], [(0, 82)])
    left = lambda **k: {r["blob_id"] for r in filters.run(px, [("d", filters.disconnected(scan=3, **k))]).select("blob_id").distinct().collect()}
    # 7 is near 6 alone, which is larger and had its turn
    assert left(smaller_than=10, need=2) == {1, 2, 3, 6}
    assert left(smaller_than=10, need=1) == {1, 2, 3, 4, 5, 6}
    # 6 has one in its cloud, and 15.5 pixels on average
    assert left(smaller_than=100, from_size=2, need=2) == {1, 2, 3, 4, 5}


def test_clouds_go_by_size(spark):
    px = strokes(spark, [(0, 0)], [(3, 0), (4, 0)], [(7, 0)], [(40, 0)])
    found = {(r.blob_id, r.seed_id, r.cloud_size) for r in filters.size_clouds(px, 3, 10).collect()}
    assert found == {(2, 2, 2), (1, 2, 2), (3, 2, 2), (4, 4, 0)}


def test_later_slices_win(spark):
    px = strokes(spark, [(x, 0) for x in range(10)], [(x, 1) for x in range(10)])
    boxes = spark.createDataFrame([(0, 2, 3, 0, 5, 1), (0, 1, 0, 0, 4, 0), (1, 1, 0, 0, 9, 9)], "frame_idx int, ord int, min_x int, min_y int, max_x int, max_y int")
    found = {(r.blob_id, r.x, r.y) for r in filters.run(px, [("slices", filters.sliced)], boxes).collect()}
    assert {(x, y) for g, x, y in found if g == 3} == {(0, 0), (1, 0), (2, 0)}
    assert {(x, y) for g, x, y in found if g == 4} == {(x, y) for x in (3, 4, 5) for y in (0, 1)}
    assert len(found) == 20


def test_no_groups(spark):
    assert filters.run(spark.createDataFrame([], PX), filters.default_steps(1, 1, 1, 1, 10, 10)).count() == 0

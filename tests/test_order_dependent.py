"""Growth, clouds and the learner: goldens and naive versions."""

import random

import pytest
from pyspark.sql import functions as F

from pixelweave.operators import grow, learn, pixel


def square(spark, centre, ring):
    rows = [(0, 5 + x, 5 + y, centre if x == y == 1 else ring) for x in range(3) for y in range(3)]
    return spark.createDataFrame(rows, "frame_idx int, x int, y int, intensity int")


@pytest.mark.parametrize(("ring", "size"), [(50, 9), (40, 1)])
def test_growth_stops_at_the_contrast_to_the_seed(spark, ring, size):
    assert grow.grow_groups(square(spark, 100, ring), 10, 60.0).count() == size


def test_growth_partitions_pixels_and_seeds_are_local_maxima(spark):
    r = random.Random(4)
    px = spark.createDataFrame([(f, x, y, r.randint(0, 100)) for f in range(2) for x in range(15) for y in range(15)], "frame_idx int, x int, y int, intensity int")
    rows = grow.grow_groups(px, 60, 30.0).collect()
    assert len({(p.frame_idx, p.x, p.y) for p in rows}) == len(rows) > 0
    groups = {}
    for p in rows:
        groups.setdefault((p.frame_idx, p.blob_id), []).append(p.intensity)
    assert all(max(g) > 60 and (max(g) - min(g)) / max(g) * 100 < 30 for g in groups.values())


def test_groups_with_a_bright_border_go_and_their_id_is_used_again(spark):
    # three groups of one pixel; the original is bright beside the second
    px = spark.createDataFrame([(0, x, y, {(2, 2): 300, (6, 2): 200, (10, 2): 150}.get((x, y), 1)) for x in range(13) for y in range(5)], "frame_idx int, x int, y int, intensity int")
    whole = px.selectExpr("frame_idx", "x", "y", "CASE WHEN x = 7 AND y = 2 THEN 900 ELSE intensity END AS intensity")
    rows = lambda *a: sorted((p.blob_id, p.x) for p in grow.grow_groups(px, 100, 50.0, *a).collect())
    assert rows() == [(1, 2), (2, 6), (3, 10)]
    assert rows(px) == [(1, 2), (2, 6), (3, 10)]
    assert rows(whole) == [(1, 2), (2, 10)]
    assert rows(whole.where("x <> 7 OR y <> 2").unionByName(px.limit(0))) == [(1, 2), (2, 6), (3, 10)]
    assert rows(whole.where("false")) == []
    # 1 brighter of 8 around is more than 0.1; pixels of a group that went stay consumed
    two = px.selectExpr("frame_idx", "x", "y", "CASE WHEN x IN (6, 7) AND y = 2 THEN 200 ELSE intensity END AS intensity")
    bright = two.selectExpr("frame_idx", "x", "y", "CASE WHEN x = 5 THEN 900 ELSE intensity END AS intensity")
    found = sorted((p.blob_id, p.x) for p in grow.grow_groups(two, 100, 50.0, bright).collect())
    assert found == [(1, 2), (2, 10)]


def test_growth_query_keeps_only_groups_that_the_border_operator_keeps(spark):
    from pixelweave.plans import queries
    from pixelweave.sources import dense_pixels

    px = dense_pixels(spark, "/root/testdata/sf0.001")
    kept = queries.grow_blobs(spark, "/root/testdata/sf0.001").cache()
    ratios = pixel.border_brightness(kept, px).collect()
    assert len(ratios) == kept.select("frame_idx", "blob_id").distinct().count() > 0
    assert all(r.ratio is not None and r.ratio < 0.1 for r in ratios)
    ids = kept.groupBy("frame_idx").agg(F.countDistinct("blob_id").alias("n"), F.max("blob_id").alias("last")).collect()
    assert all(r.n == r.last for r in ids)


def test_clouds_are_the_closure_of_pairs(spark):
    groups = spark.createDataFrame([(0, i) for i in range(1, 7)], "frame_idx int, blob_id int")
    pairs = spark.createDataFrame([(0, 1, 2), (0, 3, 2), (0, 5, 6), (0, 9, 1)], "frame_idx int, blob_id int, other_id int")
    assert {tuple(r)[1:] for r in grow.clouds(groups, pairs).collect()} == {(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1), (5, 5, 2), (6, 5, 2)}


def test_mask_kernel():
    k = {(dx, dy): w for dx, dy, w in pixel.mask_kernel()}
    assert len(k) == 109 and sum(w == 1 for w in k.values()) == 13  # 9 nearer than the inner radius, 4 at it
    assert k[1, 1] == 1 and k[5, 1] == pytest.approx(0.5) and (7, 1) not in k


def test_a_clean_cut_and_a_forest(spark):
    rows = spark.createDataFrame([(1, True, 1.0), (2, True, 2.0), (3, False, 5.0), (4, False, 7.0)], "id long, label boolean, f0 double")
    tree = learn.grow_tree(rows, ["f0"], 3)
    assert (tree.feature, tree.threshold, tree.less.value, tree.more.value) == ("f0", 3.5, 1.0, -1.0)
    assert tuple(learn.evaluate(rows, tree.column()).first()) == (4, 0)
    r = random.Random(1)
    more = spark.createDataFrame([(i, i % 2 == 0, r.gauss(i % 2, 0.6), r.random()) for i in range(200)], "id long, label boolean, f0 double, f1 double")
    trees = learn.forest(more, ["f0", "f1"], 2, 2)
    scored = more.select("label", learn.forest_score(trees).alias("s"))
    assert scored.agg(F.max(F.abs("s"))).first()[0] <= 1
    assert scored.where((F.col("s") > 0) == F.col("label")).count() > 130
    for tree, _ in trees:
        assert learn.evaluate(more, learn.prune(tree, more).column()).first()["good"] >= learn.evaluate(more, tree.column()).first()["good"]


def plain_tree(rows, names, left):
    """A node as nested lists ``[name, cut, value below, value above, below, above]`` or a number, for rows ``(label, {name: value})``; one node after the other."""
    yes, no = ([v for label, v in rows if label is want] for want in (True, False))
    if not yes or not no:
        return 1.0 if yes else -1.0
    clean, dirty = [], []
    for f in names:
        p, n = sorted(v[f] for v in yes), sorted(v[f] for v in no)
        mp, mn = p[len(p) // 2], n[len(n) // 2]
        if p[-1] < n[0]:
            clean.append(((n[0] - p[-1]) / abs(mp - mn), f, (p[-1] + n[0]) / 2, 1.0, -1.0))
        elif n[-1] < p[0]:
            clean.append(((p[0] - n[-1]) / abs(mp - mn), f, (n[-1] + p[0]) / 2, -1.0, 1.0))
        else:
            cut = (mp + mn) / 2
            lp, ln = sum(x < cut for x in p), sum(x < cut for x in n)
            gp, gn = len(p) - lp, len(n) - ln
            best = max((a / (a + b) if a + b else 0) for a, b in ((lp, ln), (gp, gn))) - len(p) / (len(p) + len(n))
            if round(best, 9) > 0:
                low, high = (a / len(p) / (a / len(p) + b / len(n)) * 2 - 1 for a, b in ((lp, ln), (gp, gn)))
                dirty.append((best, f, cut, low, high))
    if not clean + dirty:
        return None
    _, f, cut, low, high = min(clean or dirty, key=lambda c: (-round(c[0], 9), c[1]))
    if clean or left == 1:
        return [f, cut, low, high, low, high]
    sides = [plain_tree([r for r in rows if (r[1][f] < cut) is below], names, left - 1) for below in (True, False)]
    return [f, cut, low, high, *[v if s is None else s for s, v in zip(sides, (low, high), strict=True)]]


def plain_score(t, values):
    while isinstance(t, list):
        t = t[4] if values[t[0]] < t[1] else t[5]
    return t


def plain_prune(tree, rows):
    """One stump after the other, each judged by the whole tree on all rows; a queue from the root."""
    good = lambda: sum((plain_score(tree, v) >= 0) == label for label, v in rows)
    best, queue = good(), [tree] if isinstance(tree, list) else []
    while queue:
        t = queue.pop(0)
        below, above = t[4:]
        t[4:] = t[2:4]
        if good() > best:
            best = good()
            continue
        t[4:] = below, above
        queue += [c for c in (below, above) if isinstance(c, list) and isinstance(c[4], list) and isinstance(c[5], list)]
    return tree


def nested(t):
    return t.value if t.feature is None else [t.feature, t.threshold, *t.sides, nested(t.less), nested(t.more)]


@pytest.mark.parametrize(("seed", "depth"), [(1, 1), (2, 3), (3, 4)])
def test_trees_and_pruning_node_by_node(spark, seed, depth):
    r = random.Random(seed)
    names = ["f0", "f1", "f2"]

    def rows(n):
        made = [(i, r.random() < 0.3, round(r.gauss(0, 1), 2), r.randint(0, 5) / 1.0) for i in range(n)]
        return [(i, y, a + y * 0.5, b, round(r.random(), 1)) for i, y, a, b in made]

    own, other = rows(160), rows(140)
    schema = "id long, label boolean, f0 double, f1 double, f2 double"
    plain = lambda found: [(x[1], dict(zip(names, x[2:], strict=True))) for x in found]
    tree = learn.grow_tree(spark.createDataFrame(own, schema), names, depth)
    expected = plain_tree(plain(own), names, depth)
    assert nested(tree) == expected
    pruned = learn.prune(tree, spark.createDataFrame(other, schema).withColumn("tree", F.lit(1)))
    assert nested(pruned) == plain_prune(expected, plain(other))


def test_stumps_of_one_class_and_of_nothing(spark):
    schema = "label boolean, f0 double"
    tree = lambda rows: nested(learn.grow_tree(spark.createDataFrame(rows, schema), ["f0"], 2))
    assert tree([]) == -1.0 and tree([(True, 1.0)] * 3) == 1.0 and tree([(False, 1.0)]) == -1.0
    assert tree([(True, 1.0), (False, 1.0)]) == 0.0  # nothing to cut at
    assert learn.prune(learn.Node(value=0.5), spark.createDataFrame([], schema)) == learn.Node(value=0.5)


def test_forest_query_against_naive_scores(spark):
    from pixelweave.plans import queries
    from pixelweave.sources import training_rows

    data = "/root/testdata/sf0.001"
    rows = training_rows(spark, data).collect()
    trees = learn.forest(spark.createDataFrame(rows), ["f0", "f1", "f2"], 3, 3)
    found = {x["id"]: x["score"] for x in queries.forest_score(spark, data).collect()}

    def score(t, row):
        while t.feature is not None:
            t = t.less if row[t.feature] < t.threshold else t.more
        return t.value

    assert len(found) == len(rows)
    for row in rows:
        assert found[row["id"]] == pytest.approx(sum(score(t, row) * w for t, w in trees) / 3, abs=1e-8)


def test_reports_leaves_and_subsets(spark):
    rows = spark.createDataFrame([(True, 1.0), (False, 2.0), (True, 3.0)], "label boolean, f0 double")
    found = learn.report({"all": F.lit(1.0), "cut": F.when(F.col("f0") < 1.5, 1.0).otherwise(-1.0), "none": F.lit(-1.0)}, rows).collect()
    assert [(r["name"], r["good"], r["bad"], r["precision"], r["recall"]) for r in found] == [("none", 1, 2, None, 0.0), ("all", 2, 1, 2 / 3, 1.0), ("cut", 2, 1, 1.0, 0.5)]
    assert learn.feature_subsets(["a", "b", "c"]) == [["a", "b"], ["a", "c"], ["b", "c"]]
    assert [r[0] for r in rows.select(learn.linear_leaf(F.col("f0"), 1.0, 3.0)).collect()] == [-1.0, 0.0, 1.0]


def test_trees_grown_together_are_those_grown_alone_in_as_many_steps(spark, monkeypatch):
    r = random.Random(5)
    made = [(i % 3, r.random() < 0.4, r.gauss(0, 1), float(r.randint(0, 4)), None if r.random() < 0.1 else r.random()) for i in range(240)]
    rows = spark.createDataFrame([(t, y, a + y * 0.6, b, c) for t, y, a, b, c in made], "tree int, label boolean, f0 double, f1 double, f2 double").localCheckpoint()
    subsets, steps = [["f0", "f1"], ["f2"], ["f1", "f0", "f2"]], []
    alone = [learn.grow_tree(rows.where(F.col("tree") == i), names, 3) for i, names in enumerate(subsets)]
    plain = learn.written
    monkeypatch.setattr(learn, "written", lambda df, name: steps.append(name) or plain(df, name))
    assert learn.grow_trees(rows, subsets, 3) == alone
    assert steps.count("node-histogram") <= 3
    assert learn.grow_trees(rows.where("tree = 1"), subsets, 3) == [learn.Node(value=-1.0), alone[1], learn.Node(value=-1.0)]

"""The learner: splits, class statistics, splitting scores, trees grown level by level, pruning and forests."""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.functions.tables import placed, written


def fold_split(rows: DataFrame, k: int) -> DataFrame:
    """Round robin into ``k`` folds within each class, by id."""
    return placed(rows, ["label"], ["id"]).withColumn("fold", F.pmod("before", F.lit(k)).cast("int")).drop("before")


def chunk_split(rows: DataFrame, k: int) -> DataFrame:
    """``k`` runs of each class by id, of equal size; the last takes the rest."""
    counts = rows.groupBy("label").agg(F.greatest(F.floor(F.count("*") / k), F.lit(1)).alias("chunk_size"))  # a row for each class
    joined = placed(rows, ["label"], ["id"]).join(F.broadcast(counts), "label")
    return joined.withColumn("chunk", F.least(F.floor(F.col("before") / F.col("chunk_size")), F.lit(k - 1)).cast("int")).select(*rows.columns, "chunk")


def train_test_split(rows: DataFrame, every: int = 10) -> DataFrame:
    """Every tenth row is for testing, counted through the positive class and on into the negative."""
    positives = rows.agg(F.count_if("label").alias("n_pos"))
    numbered = placed(rows, ["label"], ["id"]).crossJoin(F.broadcast(positives))
    line = F.col("before") + 1 + F.when(F.col("label"), 0).otherwise(F.col("n_pos"))
    return numbered.withColumn("is_test", line % every == 0).drop("before", "n_pos")


def melt(rows: DataFrame, features: list[str]) -> DataFrame:
    """One row for each feature of each row: ``node, label, feature, value``."""
    ids = ["node", "label"]
    return rows.unpivot(ids, features, "feature", "value")


def histogram(rows: DataFrame, features: list[str]) -> DataFrame:
    """``node, label, feature, value, n``: how often each value of a feature comes in each class of each node."""
    return melt(rows, features).groupBy("node", "label", "feature", "value").agg(F.count("*").alias("n"))


def class_statistics(rows: DataFrame, features: list[str]) -> DataFrame:
    """Least, greatest, mean and upper median of each feature in each class of each node."""
    return histogram_statistics(histogram(rows, features))


def histogram_statistics(histogram: DataFrame) -> DataFrame:
    """`class_statistics` of the rows that ``histogram`` counts.

    The median is the value of rank n/2, whose counts are partial before each shuffle and summed up over ranges of values, so that a class
    needn't fit a task."""
    keys = ["node", "label", "feature"]
    # ``low`` to ``mean`` are of the same counts; a row for each node, class and feature
    ranked = written(placed(histogram, keys, ["value"], "n"), "class-histogram")
    total = ranked.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.floor(F.sum("n") / 2).alias("middle"))
    middle = ranked.join(total, keys).where((F.col("before") <= F.col("middle")) & (F.col("middle") < F.col("before") + F.col("n")))
    return middle.select(*keys, "low", "high", "mean", F.col("value").alias("median"))


def thresholds(statistics: DataFrame) -> DataFrame:
    """``node, feature, threshold, clean, gap``: halfway between the classes' bounds where they lie apart, else between their medians."""
    side = lambda label, p: statistics.where(F.col("label") == label).select("node", "feature", *[F.col(c).alias(p + c) for c in ("low", "high", "median")])
    both = side(True, "p_").join(side(False, "n_"), ["node", "feature"])
    below, above = F.col("p_high") < F.col("n_low"), F.col("n_high") < F.col("p_low")
    middle = F.when(below, (F.col("p_high") + F.col("n_low")) / 2).when(above, (F.col("n_high") + F.col("p_low")) / 2).otherwise((F.col("p_median") + F.col("n_median")) / 2)
    gap = F.when(below, F.col("n_low") - F.col("p_high")).when(above, F.col("p_low") - F.col("n_high"))
    return both.select("node", "feature", middle.alias("threshold"), (below | above).alias("clean"), F.try_divide(gap, F.abs(F.col("p_median") - F.col("n_median"))).alias("gap"))


def split_scores(rows: DataFrame, features: list[str], cuts: DataFrame) -> DataFrame:
    """``node, feature, threshold, clean, score``: how much purer a side's share of positives is than its node's; a clean
    cut scores by its gap. Cuts that gain nothing have no row. ``cuts`` is broadcast: a row for each feature of each open node, so under 2 ** depth times the features."""
    return histogram_scores(melt(rows, features).withColumn("n", F.lit(1).cast("long")), cuts)


def histogram_scores(histogram: DataFrame, cuts: DataFrame) -> DataFrame:
    """`split_scores` of the rows that ``histogram`` counts."""
    less, label, n = F.col("value") < F.col("threshold"), F.col("label"), F.col("n")
    of = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0).cast("long"))
    counted = histogram.join(F.broadcast(cuts), ["node", "feature"]).groupBy("node", "feature", "threshold", "clean", "gap").agg(of(less).alias("n_less"), of(less & label).alias("p_less"), F.sum(n).alias("n"), of(label).alias("p"))
    share = lambda p, n: F.coalesce(F.try_divide(p, n), F.lit(0.0))
    gain = F.greatest(share(F.col("p_less"), F.col("n_less")), share(F.col("p") - F.col("p_less"), F.col("n") - F.col("n_less"))) - share(F.col("p"), F.col("n"))
    return counted.select("node", "feature", "threshold", "clean", F.round(F.when(F.col("clean"), F.col("gap")).otherwise(gain), 9).alias("score")).where("score > 0")


def best_splits(scores: DataFrame) -> DataFrame:
    """Of each node the best cut: clean ones first, then by score, then by feature."""
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("clean"), F.desc("score"), "feature"))
    return scores.withColumn("place", place).where("place = 1").drop("place")


@dataclass(frozen=True)
class Node:
    """A cut with what lies below and above it, or a leaf with a value from -1 to 1. ``sides`` are the values below and above the cut when nothing follows it."""

    feature: str | None = None
    threshold: float | None = None
    less: Node | None = None
    more: Node | None = None
    value: float | None = None
    sides: tuple[float, float] | None = None

    def column(self) -> Column:
        """The tree as a nested CASE, for whole-stage code."""
        if self.feature is None:
            return F.lit(float(self.value))
        return F.when(F.col(self.feature) < self.threshold, self.less.column()).otherwise(self.more.column())

    def stump(self) -> Node:
        """The cut with a leaf on either side."""
        return Node(self.feature, self.threshold, Node(value=self.sides[0]), Node(value=self.sides[1]), sides=self.sides)


def balanced(side: tuple[int, int], whole: tuple[int, int]) -> float:
    """The value of one side of a cut with ``side`` positives and negatives of ``whole``: the classes weigh as much as each other. A side without rows is -1."""
    if not side[0] or not side[1]:
        return 1.0 if side[0] else -1.0
    p, n = side[0] / whole[0], side[1] / whole[1]
    return p / (p + n) * 2 - 1


def grow_tree(rows: DataFrame, features: list[str], depth: int) -> Node:
    """A tree over ``rows(label, features)``, see `grow_trees`."""
    return grow_trees(rows.withColumn("tree", F.lit(0)), [features], depth)[0]


def grow_trees(rows: DataFrame, features: list[list[str]], depth: int) -> list[Node]:
    """A tree for each list of ``features`` over the ``rows(tree, label, features)`` that have its number, one level at a time: each level counts the values of all nodes of
    all trees in one pass over the rows, from which statistics, cuts and scores follow; only cuts and class counts, a few numbers for each node, reach the driver.

    A node of one class is a leaf of 1 or -1. What lies on either side of a cut of the last level, or can't be cut any further, is a leaf whose value weighs the
    classes by what the node above it holds of each.
    """
    # nodes of a tree are numbered from its base on, its root being 1
    width = 2 << depth
    names = [*dict.fromkeys(n for f in features for n in f)]
    at = rows.select("label", *names, (F.col("tree") * width + 1).cast("long").alias("node"))
    tree = F.floor(F.col("node") / width)
    allowed = functools.reduce(lambda c, t: c | ((tree == t) & F.col("feature").isin(features[t])), range(len(features)), F.lit(False))
    counts: dict[int, tuple[int, int]] = {}
    cuts: dict[int, tuple[str, float]] = {}
    for level in range(depth + 1):
        own = {r["node"]: (r["p"], r["n"]) for r in at.groupBy("node").agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("n")).collect()}
        counts |= own
        open_ = [k for k, (p, n) in own.items() if p and n] if level < depth else []
        if not open_:
            break
        values = written(histogram(at.where(F.col("node").isin(open_)), names).where(allowed), "node-histogram")
        found = {r["node"]: (r["feature"], r["threshold"]) for r in best_splits(histogram_scores(values, thresholds(histogram_statistics(values)))).collect()}
        if not found:
            break
        cuts |= found
        below = lambda k: k + k % width
        step = functools.reduce(lambda c, k: c.when(F.col("node") == k, F.when(F.col(found[k][0]) < found[k][1], below(k)).otherwise(below(k) + 1)), found, F.when(F.lit(False), 0))
        at = at.where(F.col("node").isin(list(found))).withColumn("node", step.cast("long"))

    def build(base: int, k: int) -> Node:
        value = lambda k: balanced(counts.get(base + k, (0, 0)), counts.get(base + max(1, k // 2), (0, 0)))
        return Node(*cuts[base + k], build(base, 2 * k), build(base, 2 * k + 1), sides=(value(2 * k), value(2 * k + 1))) if base + k in cuts else Node(value=value(k))

    return [build(t * width, 1) for t in range(len(features))]


def evaluate(rows: DataFrame, score: Column) -> DataFrame:
    """Rows rightly and wrongly classified, a score of 0 counting as positive."""
    right = (score >= 0) == F.col("label")
    return rows.agg(F.count_if(right).alias("good"), F.count_if(~right).alias("bad"))


def prune(tree: Node, rows: DataFrame) -> Node:
    """The tree with cuts made stumps where that classifies more of ``rows`` rightly, from the top down.

    The root is tried first; below a cut that stays those are tried that have a cut on either side. Nodes of one level have no rows in common, so trying all of a level
    in one job decides as trying one after the other does."""

    def deep(t: Node) -> bool:
        return t.feature is not None and t.less.feature is not None and t.more.feature is not None

    def reached(t: Node, level: int, number: int = 1) -> Column:
        """The number of the node of this level that a row comes to; null if it ends above."""
        if level == 0 or t.feature is None:
            return F.lit(number if level == 0 else None).cast("long")
        return F.when(F.col(t.feature) < t.threshold, reached(t.less, level - 1, 2 * number)).otherwise(reached(t.more, level - 1, 2 * number + 1))

    def put(t: Node, stumps: set[int], number: int = 1) -> Node:
        if number in stumps:
            return t.stump()
        return t if t.feature is None else Node(t.feature, t.threshold, put(t.less, stumps, 2 * number), put(t.more, stumps, 2 * number + 1), sides=t.sides)

    level, tried = 0, {1: tree} if tree.feature is not None else {}
    while tried:
        cut = functools.reduce(lambda c, k: c.when(F.col("tree_node") == k, F.when(F.col(tried[k].feature) < tried[k].threshold, tried[k].sides[0]).otherwise(tried[k].sides[1])), tried, F.when(F.lit(False), 0.0))
        right = lambda score: F.count_if((score >= 0) == F.col("label"))
        at = rows.withColumn("tree_node", reached(tree, level)).withColumn("tree_score", tree.column()).where(F.col("tree_node").isin(list(tried)))
        gains = {r["tree_node"] for r in at.groupBy("tree_node").agg(right(F.col("tree_score")).alias("whole"), right(cut).alias("cut")).where("cut > whole").collect()}  # a row for each cut tried
        tree = put(tree, gains)
        tried = {n: t for k, c in tried.items() if k not in gains for n, t in ((2 * k, c.less), (2 * k + 1, c.more)) if deep(t)}
        level += 1
    return tree


def linear_leaf(feature: Column, low: float, high: float) -> Column:
    """A leaf that isn't constant: -1 at ``low``, 1 at ``high``, and between and beyond in proportion; 0 if they are equal."""
    return (feature - low) / (high - low) * 2 - 1 if high != low else F.lit(0.0)


def feature_subsets(features: list[str]) -> list[list[str]]:
    """All subsets with one feature less."""
    return [[*c] for c in itertools.combinations(features, len(features) - 1)] if features else []


def report(trees: dict[str, Column], rows: DataFrame) -> DataFrame:
    """``name, good, bad, accuracy, precision, recall`` of each tree's score on ``rows``, worst first; all trees in one pass. Without a row that is called positive there is no
    precision, without a positive one no recall."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (c >= 0).alias("called")) for n, c in trees.items()]))
    found = rows.select("label", each.alias("r")).select("label", F.col("r.name").alias("name"), F.col("r.called").alias("called")).groupBy("name").agg(
        F.count_if(F.col("called") == F.col("label")).alias("good"), F.count_if(F.col("called") != F.col("label")).alias("bad"), F.count_if(F.col("called") & F.col("label")).alias("hits"), F.count_if("called").alias("n_called"), F.count_if("label").alias("n_true"))
    shares = [F.col("good") / (F.col("good") + F.col("bad")), F.try_divide("hits", "n_called"), F.try_divide("hits", "n_true")]
    return found.select("name", "good", "bad", *[c.alias(n) for c, n in zip(shares, ("accuracy", "precision", "recall"), strict=True)]).orderBy("accuracy", "name")


def forest(rows: DataFrame, features: list[str], k: int, depth: int) -> list[tuple[Node, float]]:
    """``k`` trees, each grown without one fold, pruned on it, and weighted by its accuracy there."""
    folds, out = written(fold_split(rows, k), "folds"), []
    others = F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("tree")
    grown = grow_trees(folds.select("*", others).where("fold <> tree"), [features] * k, depth)
    for i, whole in enumerate(grown):
        own = folds.where(F.col("fold") == i)
        tree = prune(whole, own)
        r = evaluate(own, tree.column()).first()
        out.append((tree, r["good"] / max(1, r["good"] + r["bad"])))
    return out


def forest_score(trees: list[tuple[Node, float]]) -> Column:
    """The trees' values by their weights, over the number of trees."""
    return functools.reduce(lambda a, b: a + b, [t.column() * w for t, w in trees]) / len(trees)

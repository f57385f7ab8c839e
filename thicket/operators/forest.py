"""Growing, pruning and applying forests.

A tree is rows edges(tree_id, parent, child, pos, word): a history goes from `parent` to `child` if its word at `pos` is
among the child's.  Paths are strings of 0 and 1 from the root, so a node's ancestors are its path's prefixes.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import uniform32
from ..sources.tables import written
from .smoothing import Discount
from .split import ATTEMPTS, elements, search

EDGES = "tree_id int, parent string, child string, pos int, word long"
#: Levels after which what has grown, or how far rows have come, is written out.
FOLD = 8


def prefixes(path: str) -> Column:
    """All prefixes of a path, from the root to itself."""
    return F.expr(f"transform(sequence(0, length({path})), i -> substr({path}, 1, i))")


def best_splits(found: DataFrame) -> DataFrame:
    """Of each node the position of the highest gain, the smallest of equals, if it gains and both sides have a word."""
    w = Window.partitionBy("tree_id", "path", "pos")
    both = found.withColumn("sides", F.max("side").over(w) - F.min("side").over(w)).filter("sides = 1 and gain > 0")
    first = Window.partitionBy("tree_id", "path").orderBy(F.col("gain").desc(), "pos")
    return both.withColumn("r", F.dense_rank().over(first)).filter("r = 1").select("tree_id", "path", "pos", "elem", "side", "gain")


def route(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows one level down; those whose word is on neither side vanish."""
    chosen = splits.select("tree_id", "path", "pos").distinct()
    at = rows.join(chosen, ["tree_id", "path"]).withColumn("elem", F.get("ctx", F.col("pos"))).drop("pos")
    return at.join(splits.select("tree_id", "path", "elem", "side"), ["tree_id", "path", "elem"]).withColumn("path", F.concat("path", F.col("side").cast("string"))).drop("elem", "side")


def drawn_positions(nodes: DataFrame, seed: int, positions: int, mode: str, alpha: float) -> DataFrame:
    """(tree_id, path, pos): the positions to try at each node: all, or each by a coin, drawn anew until there is one."""
    every = F.array(*map(F.lit, range(positions)))
    if mode in ("none", "random-init"):
        return nodes.select("tree_id", "path", F.explode(every).alias("pos"))
    coin = lambda p, a: uniform32(seed, F.col("tree_id"), F.col("path"), p, a) < F.lit(int(alpha * 2**32))
    draws = F.transform(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), lambda a: F.filter(every, lambda p: coin(p, a)))
    first = F.get(F.filter(draws, lambda x: F.size(x) > 0), F.lit(0))
    return nodes.select("tree_id", "path", F.explode(F.coalesce(first, every)).alias("pos"))


def held_statistics(histogram: DataFrame, held: DataFrame, d: Discount) -> DataFrame:
    """(tree_id, path, logl, heldout_sum): base-10 log-likelihood of the held-out n-grams that reach a node, and their number.

    `held` has (tree_id, path, w0, cnt, p_short); a node's probabilities are its own counts' (`histogram`), discounted and
    interpolated with p_short, the back-off model's for the shortened context.  N-grams of probability 0 add nothing.
    """
    own = histogram.withColumnRenamed("cnt", "node_cnt")
    both = held.join(leaf_stats(histogram), ["tree_id", "path"]).join(own, ["tree_id", "path", "w0"], "left")
    p = d.mass(F.coalesce("node_cnt", F.lit(0)), F.col("total"), F.col("types")) + d.rest(*map(F.col, ("total", "types", "min2", "min3"))) * F.col("p_short")
    logl = F.coalesce(F.sum(F.col("cnt") * F.log10(F.when(p > 0, p))), F.lit(0.0))
    return both.groupBy("tree_id", "path").agg(logl.alias("logl"), F.sum("cnt").alias("heldout_sum"))


def grow(train: DataFrame, trees: int, order: int, seed: int, mode: str = "both", alpha: float = 0.5, heldout: DataFrame | None = None, max_depth: int | None = None, max_nodes: int | None = None) -> DataFrame:
    """EDGES of a forest, from (ctx, w0, cnt) in word ids: all trees and all nodes of a level in the same jobs.

    Trees grow until no node splits.  With `heldout`, nodes that no held-out n-gram reaches are not split.  With
    `max_nodes`, each tree tries so many nodes at most, breadth first, then by path (shallow growth); the others stay leaves.
    Past `max_depth` levels, a node that still splits is an error: nothing is left unsplit in silence.  Each level is
    written to the shared folder.
    """
    return _levels(train, trees, order, seed, mode, alpha, heldout, max_depth, max_nodes, None)[0]


def grow_measured(train: DataFrame, heldout: DataFrame, trees: int, order: int, seed: int, d: Discount, mode: str = "both", alpha: float = 0.5, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """EDGES as `grow` has them, and (tree_id, path, is_leaf, logl, heldout_sum) of every node.

    `heldout` has p_short beside (ctx, w0, cnt).  Held-out n-grams go down the tree with the training n-grams, so each level
    gives its nodes' statistics before it splits; a node that none reaches has 0 for both and is not split.
    """
    edges, measured = _levels(train, trees, order, seed, mode, alpha, heldout, max_depth, None, d)
    roots = train.sparkSession.range(trees).select(F.col("id").cast("int").alias("tree_id"), F.lit("").alias("path"))
    inner = edges.select("tree_id", F.col("parent").alias("path")).distinct().withColumn("inner", F.lit(True))
    every = roots.unionByName(edges.select("tree_id", F.col("child").alias("path")).distinct())
    full = every.join(inner, ["tree_id", "path"], "left").join(measured, ["tree_id", "path"], "left")
    return edges, full.select("tree_id", "path", F.col("inner").isNull().alias("is_leaf"), F.coalesce("logl", F.lit(0.0)).alias("logl"), F.coalesce("heldout_sum", F.lit(0)).alias("heldout_sum"))


def _levels(train: DataFrame, trees: int, order: int, seed: int, mode: str, alpha: float, heldout: DataFrame | None, max_depth: int | None, max_nodes: int | None, d: Discount | None) -> tuple[DataFrame, DataFrame | None]:
    if order < 2 or not 0 < alpha <= 1:
        raise ValueError("needs an order of 2 at least and alpha in (0, 1]")
    spark: SparkSession = train.sparkSession
    ids = spark.range(trees).select(F.col("id").cast("int").alias("tree_id"), F.lit("").alias("path"))
    here = train.select("ctx", "w0", "cnt").join(F.broadcast(ids))
    held = heldout.join(F.broadcast(ids)) if heldout is not None else None
    edges, measured, used = spark.createDataFrame([], EDGES), None, None
    for depth in count():
        if held is not None:
            reached = held.select("tree_id", "path").distinct()
            if d is not None:
                level = written(held_statistics(here.groupBy("tree_id", "path", "w0").agg(F.sum("cnt").alias("cnt")), held, d))
                measured = level if measured is None else measured.unionByName(level)
                reached = level.select("tree_id", "path")
            here = here.join(reached, ["tree_id", "path"], "left_semi")
        if max_nodes is not None:
            tried, used = _within_budget(here.select("tree_id", "path").distinct(), used, max_nodes)
            here = here.join(tried, ["tree_id", "path"], "left_semi")
        drawn = drawn_positions(here.select("tree_id", "path").distinct(), seed, order - 1, mode, alpha)
        elems = elements(here, range(order - 1)).join(drawn, ["tree_id", "path", "pos"])
        splits = written(best_splits(search(elems, seed, mode)))
        if splits.isEmpty():
            return edges, measured
        if depth == max_depth:
            raise ValueError(f"nodes still split below {max_depth} levels")
        edges = edges.unionByName(splits.select("tree_id", F.col("path").alias("parent"), F.concat("path", F.col("side").cast("string")).alias("child"), "pos", F.col("elem").alias("word")))
        if depth % FOLD == FOLD - 1:  # keep the plan of a deep tree short
            edges, measured = written(edges), None if measured is None else written(measured)
        here = written(route(here, splits))
        held = None if held is None else written(route(held, splits))


def _within_budget(nodes: DataFrame, used: DataFrame | None, most: int) -> tuple[DataFrame, DataFrame]:
    """Of a level's nodes those that each tree may still try, and (tree_id, n) tried with them."""
    before = used if used is not None else nodes.select("tree_id").distinct().withColumn("n", F.lit(0).cast("long"))
    place = F.row_number().over(Window.partitionBy("tree_id").orderBy("path"))
    tried = written(nodes.join(F.broadcast(before), "tree_id").withColumn("r", place).filter(F.col("r") + F.col("n") <= most))
    after = tried.groupBy("tree_id").agg((F.max("n") + F.count(F.lit(1))).alias("n"))
    return tried.select("tree_id", "path"), written(after)


def classify(rows: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """`rows` (with tree_id, ctx) with `path` and `found`: down to a leaf, or to where no child has the word.

    Deep trees are walked in parts of FOLD levels, each written out, so that the plan stays short.
    """
    inner = edges.select("tree_id", F.col("parent").alias("path"), "pos").distinct()
    steps = edges.select("tree_id", F.col("parent").alias("path"), F.col("word").alias("__w"), F.col("child").alias("__child"))
    df = rows.withColumn("path", F.lit("")).withColumn("found", F.lit(True))
    for level in range(depth):
        if level and level % FOLD == 0:
            df = written(df)
        df = df.join(inner, ["tree_id", "path"], "left").withColumn("__w", F.when(F.col("found"), F.get("ctx", F.col("pos"))))
        df = df.join(steps, ["tree_id", "path", "__w"], "left")
        df = df.withColumn("found", F.col("found") & (F.col("pos").isNull() | F.col("__child").isNotNull())).withColumn("path", F.coalesce("__child", "path")).drop("pos", "__w", "__child")
    return df


def leaf_histogram(classified: DataFrame) -> DataFrame:
    return classified.filter("found").groupBy("tree_id", "path", "w0").agg(F.sum("cnt").alias("cnt"))


def leaf_stats(histogram: DataFrame) -> DataFrame:
    c = F.col("cnt")
    return histogram.groupBy("tree_id", "path").agg(F.sum("cnt").alias("total"), F.count_if(c > 0).alias("types"), F.count_if(c >= 2).alias("min2"), F.count_if(c >= 3).alias("min3"))


def score(test: DataFrame, histogram: DataFrame, d: Discount) -> DataFrame:
    """`test` (classified; with p_short and p_full, the back-off model's for the shortened and the full context) with prob.

    Always interpolated where the history is in the tree; else the back-off model's, with the full context.  provenance
    says which: seen, unseen_seen (history only), unseen_history, lower_order (no full context).
    """
    hist = histogram.withColumnRenamed("cnt", "leaf_cnt")
    df = test.join(leaf_stats(histogram), ["tree_id", "path"], "left").join(hist, ["tree_id", "path", "w0"], "left")
    own = d.mass(F.coalesce("leaf_cnt", F.lit(0)), F.col("total"), F.col("types")) + d.rest(*map(F.col, ("total", "types", "min2", "min3"))) * F.col("p_short")
    inside = F.col("found") & F.col("total").isNotNull()
    label = F.when(F.col("short"), "lower_order").when(~inside, "unseen_history").when(F.col("leaf_cnt").isNull(), "unseen_seen").otherwise("seen")
    return df.withColumn("prob", F.when(inside & ~F.col("short"), own).otherwise(F.col("p_full"))).withColumn("provenance", label)


def node_paths(edges: DataFrame) -> DataFrame:
    """(tree_id, path, is_leaf) of all nodes."""
    children = edges.select("tree_id", F.col("child").alias("path")).distinct()
    roots = edges.select("tree_id", F.lit("").alias("path")).distinct()
    parents = edges.select("tree_id", F.col("parent").alias("path"), F.lit(False).alias("inner")).distinct()
    return children.unionByName(roots).join(parents, ["tree_id", "path"], "left").select("tree_id", "path", F.col("inner").isNull().alias("is_leaf"))


def tree_stats(edges: DataFrame) -> DataFrame:
    """(tree_id, nodes, leaves, depth); a leaf's depth is 1."""
    return node_paths(edges).groupBy("tree_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("is_leaf").alias("leaves"), (F.max(F.length("path")) + 1).alias("depth"))


def potentials(nodes: DataFrame) -> DataFrame:
    """`nodes` (tree_id, path, is_leaf, logl, heldout_sum) with potential: mean log-likelihood of the leaves below less its own.

    Leaves are sent to all their prefixes and summed there: one aggregation for all depths.
    """
    above = nodes.filter("is_leaf").select("tree_id", F.explode(prefixes("path")).alias("path"), "logl", "heldout_sum")
    sums = above.groupBy("tree_id", "path").agg(F.sum("logl").alias("ll"), F.sum("heldout_sum").alias("ls"))
    mean = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b)).otherwise(0.0)
    return nodes.join(sums, ["tree_id", "path"], "left").withColumn("potential", F.when(F.col("is_leaf"), 0.0).otherwise(mean("ll", "ls") - mean("logl", "heldout_sum"))).drop("ll", "ls")


def prune(nodes: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Nodes (with potential) that stay, with is_leaf anew: none below an inner node of `threshold` or less."""
    cut = nodes.filter(~F.col("is_leaf") & (F.col("potential") <= threshold)).select("tree_id", F.col("path").alias("above"))
    proper = nodes.select("tree_id", "path", F.explode_outer(F.expr("transform(sequence(0, length(path) - 1), i -> substr(path, 1, i))")).alias("above")).filter("path <> ''")
    gone = proper.join(cut, ["tree_id", "above"], "left_semi").select("tree_id", "path").distinct()
    stays = nodes.join(gone, ["tree_id", "path"], "left_anti")
    return stays.withColumn("is_leaf", F.col("is_leaf") | (F.col("potential") <= threshold))


def leaf_ids(nodes: DataFrame) -> DataFrame:
    """(tree_id, path, leaf_id): numbers from 1 in order of paths; a tree's leaves are sorted in one task."""
    return nodes.filter("is_leaf").select("tree_id", "path", F.row_number().over(Window.partitionBy("tree_id").orderBy("path")).alias("leaf_id"))


def prune_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    return edges.join(kept.select("tree_id", F.col("path").alias("child")), ["tree_id", "child"], "left_semi")

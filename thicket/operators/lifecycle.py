"""A forest's life: growth with held-out text, pruning, refilled leaves, scored test text, and a model to export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import truncated
from ..sources.corpus import END
from ..sources.tables import written
from . import evaluate, forest
from .counts import test_counts
from .smoothing import BackoffModel, Discount, backoff_weights


def backed_off(grams: DataFrame, model: BackoffModel, order: int) -> DataFrame:
    """`grams` (ctx, w0) with p_full, the back-off model's probability, and p_short, that for the newest order - 2 words."""
    if order == model.order:
        return model.prob(grams, "p_full", "p_short")
    full = model.prob(grams, "p_full")
    short = model.prob(full.withColumn("long_ctx", F.col("ctx")).withColumn("ctx", truncated(F.col("ctx"), order - 2)), "p_short")
    return short.withColumn("ctx", F.col("long_ctx")).drop("long_ctx")


def measure(edges: DataFrame, train: DataFrame, heldout: DataFrame, d: Discount) -> DataFrame:
    """(tree_id, path, is_leaf, logl, heldout_sum) of given trees: as `forest.grow_measured` has them for those it grows.

    `train` has (ctx, w0, cnt), `heldout` p_short as well.  Rows count at every node that they pass.
    """
    nodes = written(forest.node_paths(edges))
    ids, depth = F.broadcast(edges.select("tree_id").distinct()), _depth(edges)

    def passing(rows: DataFrame, *columns: str) -> DataFrame:
        return forest.classify(rows.join(ids), edges, depth).select("tree_id", F.explode(forest.prefixes("path")).alias("path"), *columns)

    hist = passing(train, "w0", "cnt").groupBy("tree_id", "path", "w0").agg(F.sum("cnt").alias("cnt"))
    found = forest.held_statistics(written(hist), passing(heldout, "w0", "cnt", "p_short"), d)
    return nodes.join(found, ["tree_id", "path"], "left").fillna({"logl": 0.0, "heldout_sum": 0})


def _depth(edges: DataFrame) -> int:
    return edges.agg(F.max(F.length("child"))).first()[0] or 0


def pruned(edges: DataFrame, nodes: DataFrame, threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes left where a subtree that gains `threshold` or less, on the held-out text, becomes a leaf."""
    kept = written(forest.prune(forest.potentials(nodes), threshold))
    return forest.prune_edges(edges, kept), kept


def score(test: DataFrame, filling: DataFrame, edges: DataFrame, trees: DataFrame, d: Discount, order: int) -> DataFrame:
    """`test` (ord, ctx, w0, cnt, p_full, p_short) for each of `trees` (tree_id), with prob and provenance.

    Leaves are filled anew from `filling` (ctx, w0, cnt), which need not be what the trees grew on; only n-grams whose leaf
    some test n-gram reaches are gathered.  N-grams with a context of fewer than order - 1 words are the back-off model's;
    so are those whose history no tree has.  A leaf that the test reaches but nothing fills is an error.
    """
    depth, ids = _depth(edges), F.broadcast(trees)
    at = written(forest.classify(test.withColumn("short", F.size("ctx") < order - 1).join(ids), edges, depth))
    reached = at.filter("found and not short").select("tree_id", "path").distinct()
    hist = written(forest.leaf_histogram(forest.classify(filling.join(ids), edges, depth).join(reached, ["tree_id", "path"], "left_semi")))
    if not reached.join(hist, ["tree_id", "path"], "left_anti").isEmpty():
        raise ValueError("the test reaches a leaf without training data")
    return forest.score(at, hist, d)


def perplexities(scored: DataFrame, end: str) -> DataFrame:
    """(model, ppl): each tree by itself, and `forest`, their uniform mixture."""
    named = scored.select(F.col("tree_id").cast("string").alias("model"), "ord", "ctx", F.col("w0").cast("string").alias("w0"), "cnt", "prob")
    mixed = evaluate.mix(named, keys=("ord", "ctx", "w0", "cnt")).withColumn("model", F.lit("forest"))
    sums = named.unionByName(mixed.select(named.columns)).groupBy("model").agg(F.sum(F.col("cnt") * F.log10("prob")).alias("l"), F.sum("cnt").alias("n"))
    return sums.select("model", F.pow(F.lit(10.0), -F.col("l") / F.col("n")).alias("ppl"))


def exported(scored: DataFrame, model: BackoffModel, stats: DataFrame, order: int, begin: str | int, end: str | int = END) -> DataFrame:
    """(ord, ctx, w0, logp, log_bow): an explicit model of the n-grams in `stats` (ord, ctx, w0, cnt).

    The top order has the probabilities of `scored` (ctx, w0, prob), all others the back-off model's.  Left out are contexts
    that end a sentence, and n-grams that do not occur; `begin` has a unigram of probability 0.  Each context has the weight
    that makes it sum to 1 with the shorter context's probabilities; one that leaves nothing over has weight 0.
    """
    seen = stats.filter((F.col("cnt") > 0) & (F.col("ord") <= order) & ~F.exists("ctx", lambda w: w == end) & (F.col("w0") != begin))
    seen = written(seen.select("ord", "ctx", "w0").distinct())
    every = written(model.prob(seen, "p_model"))
    top = scored.select("ctx", "w0", F.col("prob").alias("p_tree"))
    probs = written(every.join(top, ["ctx", "w0"], "left").select("ord", "ctx", "w0", F.when(F.col("ord") == order, F.coalesce("p_tree", "p_model")).otherwise(F.col("p_model")).alias("p")))
    out = probs.filter("ord = 1").select("ord", "ctx", "w0", "p")
    weights = None
    for k in range(2, order + 1):
        low = lookup(probs.filter(F.col("ord") == k), probs, weights, k - 1)
        bows = backoff_weights(low).select("ctx", "bow")
        weights = written(bows if weights is None else weights.unionByName(bows))
        out = out.unionByName(probs.filter(F.col("ord") == k).select("ord", "ctx", "w0", "p"))
    log = lambda c: F.when(F.col(c) > 0, F.log10(c)).otherwise(-99.0)
    none, word = F.array().cast(seen.schema["ctx"].dataType), F.lit(begin).cast(seen.schema["w0"].dataType)
    first = seen.sparkSession.range(1).select(F.lit(1).alias("ord"), none.alias("ctx"), word.alias("w0"), F.lit(0.0).alias("p"))
    out = out.unionByName(first).withColumn("as_ctx", F.concat(F.array("w0"), F.col("ctx")))
    if weights is None:
        return out.select("ord", "ctx", "w0", log("p").alias("logp"), F.lit(None).cast("double").alias("log_bow"))
    return out.join(weights.select(F.col("ctx").alias("as_ctx"), "bow"), "as_ctx", "left").select("ord", "ctx", "w0", log("p").alias("logp"), F.when(F.col("bow").isNotNull(), log("bow")).alias("log_bow"))


def lookup(grams: DataFrame, probs: DataFrame, weights: DataFrame | None, order: int) -> DataFrame:
    """`grams` (ctx, w0, p) with p_low: by the explicit probabilities and weights of orders up to `order`, context cut to fit."""
    df = grams.join(probs.filter("ord = 1").select(F.col("w0").alias("u"), F.col("p").alias("p_low")), F.col("w0") == F.col("u"), "left").drop("u")
    for k in range(2, order + 1):
        own = probs.filter(F.col("ord") == k).select(F.col("ctx").alias("c"), F.col("w0").alias("u"), F.col("p").alias("p_own"))
        df = df.withColumn("key", F.slice("ctx", 1, k - 1)).join(own, (F.col("key") == F.col("c")) & (F.col("w0") == F.col("u")), "left")
        df = df.join(weights.select(F.col("ctx").alias("b"), "bow"), F.col("key") == F.col("b"), "left")
        df = df.withColumn("p_low", F.coalesce("p_own", F.coalesce("bow", F.lit(1.0)) * F.col("p_low"))).drop("c", "u", "p_own", "b", "bow", "key")
    return df


def scorable(counts: DataFrame, order: int, begin: str | int) -> DataFrame:
    """The n-grams by which a text is scored, each of its words once: see `test_counts`; `begin` is never predicted."""
    return test_counts(counts, order, begin).filter(F.col("w0") != begin)

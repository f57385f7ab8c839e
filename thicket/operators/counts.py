"""N-gram counts: (ord, ctx, w0, cnt), where ctx has the newest word first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import truncated
from ..sources.corpus import BEGIN

KEY = ("ord", "ctx", "w0")


def ngram_counts(sentences: DataFrame, order: int) -> DataFrame:
    """Counts of all n-grams up to `order`.

    A token is a row with the words before it, cut where the row is made; only those of the top order are counted from
    tokens, each lower order sums the distinct n-grams of the next one.  `room` is the number of words before, so that what a
    sentence's start cuts short is no n-gram of the order, and no word need stand for it.  The outer explode infers no
    filter that would cut the sentences a second time; rows are taken by order where the filter cannot sink below the
    counts, so that all orders read the same shuffles.
    """
    h = [f"h{k}" for k in range(1, order)]
    tokens = sentences.select("words", F.posexplode_outer("words").alias("at", "w0")).filter("at is not null")
    room = F.least(F.col("at"), F.lit(order - 1)).cast("byte")
    tokens = tokens.select("w0", *(F.get("words", F.col("at") - k).alias(f"h{k}") for k in range(1, order)), room.alias("room"))
    level = tokens.groupBy("w0", *h, "room").agg(F.count(F.lit(1)).alias("cnt"))
    levels = [level]
    for k in range(order - 1, 0, -1):
        shorter = level.select("w0", *h[: k - 1], F.least("room", F.lit(k - 1).cast("byte")).alias("room"), "cnt")
        level = shorter.groupBy("w0", *h[: k - 1], "room").agg(F.sum("cnt").alias("cnt"))
        levels.append(level)

    def rows(k: int, of: DataFrame) -> DataFrame:
        ctx = F.array(*h[: k - 1]) if k > 1 else F.array().cast(sentences.schema["words"].dataType)
        return of.filter(F.when(F.col("cnt") > 0, F.col("room")) == k - 1).select(F.lit(k).alias("ord"), ctx.alias("ctx"), "w0", "cnt")

    return reduce(DataFrame.unionByName, (rows(order - i, x) for i, x in enumerate(levels)))


def min_counts(counts: DataFrame, least: dict[int, int]) -> DataFrame:
    """Drop n-grams whose count is below the least one of their order (1 if not given)."""
    bound = reduce(lambda c, k: F.when(F.col("ord") == k, least[k]).otherwise(c), least, F.lit(1))
    return counts.filter(F.col("cnt") >= bound)


def merge(*counts: DataFrame) -> DataFrame:
    """Sum of counts of several sources."""
    return reduce(DataFrame.unionByName, counts).groupBy(*KEY).agg(F.sum("cnt").alias("cnt"))


def recompute(counts: DataFrame, order: int) -> DataFrame:
    """Counts of `order` from those of the next order: sums over the last word, so of n-grams as prefixes."""
    higher = counts.filter(F.col("ord") == order + 1)
    prefix = higher.select(F.lit(order).alias("ord"), F.slice("ctx", 2, order).alias("ctx"), F.get("ctx", F.lit(0)).alias("w0"), "cnt")
    return prefix.groupBy(*KEY).agg(F.sum("cnt").alias("cnt"))


def test_counts(counts: DataFrame, order: int, begin: str | int = BEGIN) -> DataFrame:
    """The top order, and of lower ones down to 2 those that begin a sentence: each word of a text is predicted once."""
    return counts.filter((F.col("ord") == order) | ((F.col("ord") > 1) & (F.get("ctx", F.size("ctx") - 1) == begin)))


def continuation(counts: DataFrame, order: int, begin: str | int = BEGIN) -> DataFrame:
    """Kneser-Ney counts: the top order raw, below it the number of distinct words before; n-grams from <s> stay raw."""
    top = counts.filter(F.col("ord") == order)
    starts = counts.filter((F.col("ord") < order) & ((F.col("ord") > 1) & (F.get("ctx", F.size("ctx") - 1) == begin)))
    above = counts.filter((F.col("ord") > 1) & (F.col("ord") <= order))
    shorter = above.select((F.col("ord") - 1).alias("ord"), F.expr("slice(ctx, 1, greatest(ord - 2, 0))").alias("ctx"), "w0", F.lit(None).cast("long").alias("raw"))
    both = shorter.unionByName(starts.select(*KEY, F.col("cnt").alias("raw"))).groupBy(*KEY).agg(F.max("raw").alias("raw"), F.count(F.lit(1)).alias("n"))
    return top.unionByName(both.select(*KEY, F.coalesce("raw", "n").alias("cnt")))


def context_stats(counts: DataFrame) -> DataFrame:
    """(ord, ctx, total, types, min2, min3): followers of each context, and those seen twice and three times."""
    c = F.col("cnt")
    return counts.filter(c > 0).groupBy("ord", "ctx").agg(
        F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("types"), F.count_if(c >= 2).alias("min2"), F.count_if(c >= 3).alias("min3")
    )


def counts_of_counts(counts: DataFrame) -> DataFrame:
    """(ord, n1, n2, n3, n4)."""
    return counts.groupBy("ord").agg(*(F.count_if(F.col("cnt") == k).alias(f"n{k}") for k in range(1, 5)))


def truncated_contexts(counts: DataFrame, n: int) -> DataFrame:
    return counts.withColumn("ctx", truncated(F.col("ctx"), n))

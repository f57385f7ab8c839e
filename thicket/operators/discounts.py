"""Discounts that need more than counts of counts up to four: Good-Turing by Katz, and natural."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counts import context_stats
from .smoothing import BackoffModel, Discount


def good_turing(counts: DataFrame, gt_max: int = 5) -> DataFrame:
    """(ord, r, n_r, factor) for r = 1..gt_max: what a count of r is multiplied by (Katz 1987); larger counts stay.

    With r* = (r + 1) n[r+1] / n[r] and A = (gt_max + 1) n[gt_max+1] / n[1], the factor is (r*/r - A) / (1 - A).  It is 1 where
    a count of counts that it divides by is 0, or where it falls outside (0, 1].
    """
    at = lambda r: F.count_if(F.col("cnt") == r).alias(f"n{r}")
    n = counts.groupBy("ord").agg(*(at(r) for r in range(1, gt_max + 2)))
    common = F.when(F.col("n1") > 0, (gt_max + 1) * F.col(f"n{gt_max + 1}") / F.col("n1"))

    def row(r: int) -> Column:
        raw = ((r + 1) * F.col(f"n{r + 1}") / F.when(F.col(f"n{r}") > 0, F.col(f"n{r}")) / r - common) / F.when(common != 1, 1 - common)
        return F.struct(F.lit(r).alias("r"), F.col(f"n{r}").alias("n_r"), F.when((raw > 0) & (raw <= 1), raw).otherwise(1.0).alias("factor"))

    return n.select("ord", F.explode(F.array(*(row(r) for r in range(1, gt_max + 1)))).alias("x")).select("ord", "x.*")


def good_turing_probs(grams: DataFrame, counts: DataFrame, order: int, n_words: int, gt_max: int = 5, out: str = "p") -> DataFrame:
    """`grams` (ctx, w0) with P(w0 | ctx): discounted shares, what is left over goes to the next shorter context.

    A context whose counts all exceed gt_max leaves nothing over: words not seen after it get 0.
    """
    factors = F.broadcast(good_turing(counts, gt_max).select("ord", F.col("r").cast("long").alias("cnt"), "factor"))  # gt_max rows an order
    kept = counts.join(factors, ["ord", "cnt"], "left").withColumn("kept", F.col("cnt") * F.coalesce("factor", F.lit(1.0)))
    totals = kept.groupBy("ord", "ctx").agg(F.sum("cnt").alias("total"), (1 - F.sum("kept") / F.sum("cnt")).alias("rest"))
    df = grams.withColumn("__p", F.lit(1.0 / n_words))
    for k in range(1, order + 1):
        at = df.withColumn("__k", F.when(F.size("ctx") >= k - 1, F.slice("ctx", 1, k - 1)))
        at = at.join(totals.filter(F.col("ord") == k).select(F.col("ctx").alias("__k"), "total", "rest"), "__k", "left")
        here = kept.filter(F.col("ord") == k).select(F.col("ctx").alias("__k"), F.col("w0").alias("__w"), "kept")
        at = at.join(here.withColumnRenamed("__k", "__c"), (F.col("__k") == F.col("__c")) & (F.col("w0") == F.col("__w")), "left")
        p = F.coalesce(F.col("kept") / F.col("total"), F.lit(0.0)) + F.col("rest") * F.col("__p")
        df = at.withColumn("__p", F.when(F.col("total").isNotNull(), p).otherwise(F.col("__p"))).select(*grams.columns, "__p")
    return df.withColumnRenamed("__p", out)


class Natural(Discount):
    """Ristad's natural law of succession (1995): of n events of q types a seen word's share is (c + 1)(n + 1 - q) / (n² + n + 2q)."""

    def mass(self, cnt: Column, total: Column, types: Column) -> Column:
        return F.when(cnt > 0, (cnt + 1) * (total + 1 - types) / (total * total + total + 2 * types)).otherwise(0.0)

    def rest(self, total: Column, types: Column, min2: Column, min3: Column) -> Column:
        return types * (types + 1) / (total * total + total + 2 * types)


def train_natural(counts: DataFrame, order: int, non_events: tuple[str, ...] = ("<s>",)) -> BackoffModel:
    """Interpolated model of raw counts with natural discounting in every order."""
    events = counts.filter((F.col("ord") <= order) & ~F.col("w0").isin(*non_events))
    n_words = events.filter(F.col("ord") == 1).count()
    return BackoffModel(order, events, context_stats(events), n_words, {k: Natural() for k in range(1, order + 1)})


def tagged_stats(counts: DataFrame, tag: str) -> DataFrame:
    """(ord, ctx, total, types, min2, min3) where words ``<tag>k`` stand for counts of counts: cnt types that occur k times each.

    k = 0 adds to the total alone.  Words without the tag count as usual.
    """
    k = F.when(F.col("w0").startswith(tag), F.expr(f"try_cast(substr(w0, {len(tag) + 1}) as bigint)"))
    n = F.col("cnt")
    when = lambda least: F.sum(F.when(k.isNull(), (n >= least).cast("long")).otherwise(F.when(k >= least, n).otherwise(0)))
    total = F.sum(F.when(k.isNull() | (k == 0), n).otherwise(k * n))
    return counts.groupBy("ord", "ctx").agg(total.alias("total"), when(1).alias("types"), when(2).alias("min2"), when(3).alias("min3"))

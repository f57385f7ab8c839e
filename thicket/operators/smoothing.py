"""Discounts and interpolated back-off models."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .counts import context_stats, continuation, counts_of_counts, min_counts

#: D1, D2, D3+ where counts of counts are degenerate.
FALLBACK = (0.5, 0.75, 0.9)


@dataclass(frozen=True)
class Discount:
    """How a count shrinks and what the context passes on: 'absolute' with D1, D2, D3+, or 'witten-bell'."""

    method: str = "absolute"
    d: tuple[float, float, float] = FALLBACK
    fallback: bool = False

    def mass(self, cnt: Column, total: Column, types: Column) -> Column:
        """What a word of this count gets before interpolation; 0 for no count."""
        if self.method == "witten-bell":
            return F.when(cnt > 0, cnt / (total + types)).otherwise(0.0)
        d1, d2, d3 = self.d
        return F.when(cnt > 0, (cnt - F.when(cnt == 1, d1).when(cnt == 2, d2).otherwise(d3)) / total).otherwise(0.0)

    def rest(self, total: Column, types: Column, min2: Column, min3: Column) -> Column:
        """Weight of the lower order."""
        if self.method == "witten-bell":
            return types / (total + types)
        d1, d2, d3 = self.d
        return (d1 * (types - min2) + d2 * (min2 - min3) + d3 * min3) / total


def discount_columns(coc: DataFrame) -> DataFrame:
    """(ord, n1..n4, y, d1, d2, d3): modified Kneser-Ney; null where a count of counts that it divides by is 0; D in [0, k]."""
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    part = lambda k: F.when((F.col("n1") > 0) & (F.col(f"n{k}") > 0), F.greatest(F.lit(0.0), F.least(F.lit(float(k)), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))))
    return coc.select("*", F.when((F.col("n1") > 0) & (F.col("n2") > 0), y).alias("y"), *(part(k).alias(f"d{k}") for k in (1, 2, 3)))


def estimate(counts: DataFrame, method: str = "modified", least: dict[int, int] | None = None) -> dict[int, Discount]:
    """A discount for each order; the table that is collected has a row an order.  'modified', 'original', 'witten-bell'.

    `least` has the least count of an order that takes part.  Where a count of counts that a discount divides by is 0, all
    three are FALLBACK and the discount says so (`fallback`).
    """
    out = {}
    for r in discount_columns(counts_of_counts(min_counts(counts, least or {}))).collect():
        d = (r["y"],) * 3 if method == "original" else (r["d1"], r["d2"], r["d3"])
        absolute = Discount(d=FALLBACK, fallback=True) if None in d else Discount(d=d)
        out[r["ord"]] = Discount("witten-bell") if method == "witten-bell" else absolute
    return out


@dataclass(frozen=True)
class BackoffModel:
    """Counts and context statistics by order, with a discount for each; words that are predicted number `n_words`."""

    order: int
    counts: DataFrame
    stats: DataFrame
    n_words: int
    discounts: dict[int, Discount] = field(default_factory=dict)

    def prob(self, grams: DataFrame, out: str = "p", low: str | None = None) -> DataFrame:
        """`grams` (with ctx, w0) with P(w0 | ctx): from uniform upwards, each order interpolated where it has the context.

        `low`, if given, names a column for the probability of the next lower order, that of the order - 2 newest words.
        """
        df = self._level(grams, self.order).withColumnRenamed("__p", out)
        return df.withColumnRenamed("__q", low) if low else df.drop("__q")

    def _level(self, rows: DataFrame, k: int) -> DataFrame:
        """`rows` with __p, of order `k`, and __q, of the order below, which is found once for each distinct shorter n-gram.

        Only the one row of the empty context is broadcast.  All else is joined by shuffle, on a hash before the words, so that
        sorts compare numbers; the words are compared as well.
        """
        n = self.counts.filter(F.col("ord") == k)
        hist = n.select(F.xxhash64("ctx", "w0").alias("__hh"), F.col("ctx").alias("__c"), F.col("w0").alias("__w"), F.col("cnt").alias("__n"))
        stats = self.stats.filter(F.col("ord") == k).select(F.xxhash64("ctx").alias("__sh"), F.col("ctx").alias("__s"), "total", "types", "min2", "min3")
        df = rows.withColumn("__k", F.when(F.size("ctx") >= k - 1, F.slice("ctx", 1, k - 1)))
        if k == 1:
            df = df.withColumn("__q", F.lit(1.0 / self.n_words)).join(F.broadcast(stats), F.size("ctx") >= 0, "left")
        elif rows.isStreaming:  # a stream is joined to tables only, row by row
            df = self._level(rows, k - 1).drop("__q").withColumnRenamed("__p", "__q").withColumn("__k", F.when(F.size("ctx") >= k - 1, F.slice("ctx", 1, k - 1)))
        else:
            short = F.slice("ctx", 1, k - 2)
            found = self._level(rows.select(short.alias("ctx"), "w0").distinct(), k - 1)
            found = found.select(F.xxhash64("ctx", "w0").alias("__lh"), F.col("ctx").alias("__l"), F.col("w0").alias("__v"), F.col("__p").alias("__q"))
            df = df.withColumn("__cut", short).withColumn("__h", F.xxhash64("__cut", "w0"))
            df = df.join(found, (F.col("__h") == F.col("__lh")) & F.col("__cut").eqNullSafe(F.col("__l")) & F.col("w0").eqNullSafe(F.col("__v")), "left")
        if k > 1:
            df = df.join(stats, (F.xxhash64("__k") == F.col("__sh")) & (F.col("__k") == F.col("__s")), "left")
        df = df.join(hist, (F.xxhash64("__k", "w0") == F.col("__hh")) & (F.col("__k") == F.col("__c")) & (F.col("w0") == F.col("__w")), "left")
        d = self.discounts[k]
        here = d.mass(F.coalesce("__n", F.lit(0)), F.col("total"), F.col("types")) + d.rest(*map(F.col, ("total", "types", "min2", "min3"))) * F.col("__q")
        return df.select(*rows.columns, F.when(F.col("total").isNotNull(), here).otherwise(F.col("__q")).alias("__p"), "__q")


def train(counts: DataFrame, order: int, method: str = "modified", non_events: tuple[str | int, ...] = ("<s>",), discounts: dict[int, Discount] | None = None) -> BackoffModel:
    """Interpolated model of raw counts; Kneser-Ney methods count continuations below the top order.

    The first of `non_events` begins a sentence.  `discounts`, as read from a file, replace the estimated ones.
    """
    events = counts.filter((F.col("ord") <= order) & ~F.col("w0").isin(*non_events))
    used = events if method == "witten-bell" else written(continuation(events, order, non_events[0]))  # read by each order, and for the discounts
    n_words = counts.filter((F.col("ord") == 1) & ~F.col("w0").isin(*non_events)).count()
    stats = context_stats(used) if method == "witten-bell" else written(context_stats(used))
    return BackoffModel(order, used, stats, n_words, discounts or estimate(used, method))


def backoff_weights(probs: DataFrame, lower: str = "p_low", own: str = "p") -> DataFrame:
    """(ctx, bow) from explicit (ctx, w0, p, p_low): (1 - sum p) / (1 - sum of the shorter context's p over the same words)."""
    left = probs.groupBy("ctx").agg((1 - F.sum(own)).alias("a"), (1 - F.sum(lower)).alias("b"))
    return left.select("ctx", F.when(F.col("b") > 1e-12, F.col("a") / F.col("b")).otherwise(1.0).alias("bow"))

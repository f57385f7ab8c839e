"""Perplexity, mixtures and adaptation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .smoothing import BackoffModel


def perplexity(scored: DataFrame, prob: str = "prob", end: str = "</s>", unknown: str | None = None) -> DataFrame:
    """One row (sentences, words, oovs, zeroprobs, logprob, ppl, ppl1) of (w0, cnt, prob); base 10.

    With `unknown`, words that stand for unknown ones count as oovs and take no part in the logprob and the perplexities.
    """
    p, c = F.col(prob), F.col("cnt")
    oov = (F.col("w0") == unknown) if unknown else F.lit(False)
    of = lambda when, x=c: F.sum(F.when(when, x))
    sums = scored.agg(
        F.coalesce(of(F.col("w0") == end), F.lit(0)).alias("sentences"),
        F.coalesce(of(F.col("w0") != end), F.lit(0)).alias("words"),
        F.coalesce(of(oov), F.lit(0)).alias("oovs"),
        F.coalesce(of(~oov & ~(p > 0)), F.lit(0)).alias("zeroprobs"),
        of(~oov & (p > 0), c * F.log10(p)).alias("logprob"),
    )
    ten = lambda n: F.pow(F.lit(10.0), -F.col("logprob") / n)
    words = F.col("words") - F.col("oovs") - F.col("zeroprobs")
    return sums.withColumn("ppl", ten(words + F.col("sentences"))).withColumn("ppl1", ten(words))


def mix(scored: DataFrame, weights: DataFrame | None = None, keys: tuple[str, ...] = ("ctx", "w0"), models: int | None = None) -> DataFrame:
    """(keys, prob): weighted sum of the models' probabilities by tree_id; uniform without weights (tree_id, weight).

    Weights must be one for each of `models`, if given, and sum to 1.  An n-gram that one of `models` lacks has probability 0
    there; without the number, the mean is over those that have it.
    """
    if weights is None:
        return scored.groupBy(*keys).agg((F.sum("prob") / models if models else F.avg("prob")).alias("prob"))
    n, total = weights.agg(F.count(F.lit(1)), F.sum("weight")).first()
    if models not in (None, n) or abs((total or 0) - 1) > 1e-6:
        raise ValueError(f"{n} weights with sum {total} for {models or n} models")
    return scored.join(F.broadcast(weights), "tree_id").groupBy(*keys).agg(F.sum(F.col("weight") * F.col("prob")).alias("prob"))


def interpolated(scored: DataFrame, shares: dict[str, float], out: str = "prob") -> DataFrame:
    """`scored` with the mixture of models given as columns: `shares` of all but the first, which has the rest."""
    first, *others = shares
    rest = 1 - sum(shares[c] for c in others)
    if rest < 0 or min(shares[c] for c in others) < 0:
        raise ValueError("shares must not be negative, nor sum to more than 1")
    return scored.withColumn(out, sum((shares[c] * F.col(c) for c in others), rest * F.col(first)))


def em_step(scored: DataFrame, lam: Column) -> DataFrame:
    """One row (lambda): the mean posterior of the first of two models p1, p2, by cnt."""
    post = lam * F.col("p1") / (lam * F.col("p1") + (1 - lam) * F.col("p2"))
    return scored.agg((F.sum(F.col("cnt") * post) / F.sum("cnt")).alias("lambda"))


def em_lambda(scored: DataFrame, steps: int = 20, start: float = 0.5) -> float:
    """The mixture weight of two models by expectation maximisation: an aggregate to one number for each step."""
    lam = start
    for _ in range(steps):
        lam = em_step(scored, F.lit(lam)).first()[0]
    return lam


def cache_probs(tokens: DataFrame, length: int, partition: str, order: list[str], word: str) -> DataFrame:
    """`tokens` with cache_p: the share of the token among the `length` tokens before it, 0 at the start."""
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(-length, -1)
    past = F.collect_list(word).over(w)
    same = F.size(F.filter(past, lambda x: x == F.col(word)))
    return tokens.withColumn("cache_p", F.when(F.size(past) > 0, same / F.size(past)).otherwise(0.0))


def cache_mix(tokens: DataFrame, lam: float, p: str = "p") -> DataFrame:
    """`tokens` (with cache_p) with prob: `lam` of the cache, the rest of the model."""
    return tokens.withColumn("prob", lam * F.col("cache_p") + (1 - lam) * F.col(p))


def bayes_mix(tokens: DataFrame, length: int, scale: float, partition: str, order: list[str], models: tuple[str, ...] = ("p1", "p2"), priors: tuple[float, ...] | None = None) -> DataFrame:
    """`tokens` with prob: weights are the models' priors times how well each did on the `length` tokens before.

    `models` are columns of probabilities; without priors they are alike.
    """
    if priors is not None and (len(priors) != len(models) or abs(sum(priors) - 1) > 1e-6):
        raise ValueError("needs a prior for each model, with sum 1")
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(-length, -1)
    fit = lambda p, k: (priors[k] if priors else 1.0) * F.exp(scale * F.coalesce(F.sum(F.log(p)).over(w), F.lit(0.0)))
    weighed = tokens.withColumn("weights", F.array(*(fit(p, k) for k, p in enumerate(models))))
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return weighed.withColumn("prob", sum(F.get("weights", F.lit(k)) * F.col(p) for k, p in enumerate(models)) / total).drop("weights")


def adapt_marginals(probs: DataFrame, base: DataFrame, target: DataFrame, beta: float) -> DataFrame:
    """(ctx, w0, prob): prob times (target marginal / base marginal) ** beta, normalised within the context."""
    ratio = probs.join(base.toDF("w0", "pb"), "w0").join(target.toDF("w0", "pt"), "w0").withColumn("x", F.col("prob") * F.pow(F.col("pt") / F.col("pb"), F.lit(beta)))
    total = ratio.groupBy("ctx").agg(F.sum("x").alias("z"))
    return ratio.join(total, "ctx").select("ctx", "w0", (F.col("x") / F.col("z")).alias("prob"))


def nbest(hyps: DataFrame, lmw: float, wtw: float, most: int | None = None, reorder: bool = True) -> DataFrame:
    """(sent_id, hyp_id, total, rank) of (sent_id, hyp_id, ac, lm, n_words): rank 1 has the highest weighted score.

    `most` hypotheses of a sentence are looked at, the first ones by hyp_id.  Without `reorder`, ranks follow hyp_id.
    """
    total = F.col("ac") + lmw * F.col("lm") + wtw * F.col("n_words")
    by_id = Window.partitionBy("sent_id").orderBy("hyp_id")
    some = hyps.withColumn("place", F.row_number().over(by_id))
    some = some.filter(F.col("place") <= most) if most is not None else some
    w = Window.partitionBy("sent_id").orderBy(*([F.col("total").desc()] if reorder else []), "hyp_id")
    return some.select("sent_id", "hyp_id", total.alias("total")).withColumn("rank", F.row_number().over(w))


def dump(lines: DataFrame, model: BackoffModel) -> DataFrame:
    """(line_no, value): each line's n-gram with its probability behind a tab, from (line_no, value), in the order of the lines."""
    words = F.split(F.trim("value"), r"\s+")
    grams = lines.select("line_no", F.trim("value").alias("gram"), F.reverse(F.slice(words, 1, F.size(words) - 1)).alias("ctx"), F.element_at(words, -1).alias("w0"))
    return model.prob(grams, "p").select("line_no", F.format_string("%s\t%.6f", "gram", "p").alias("value")).orderBy("line_no")


def rescore_lines(hyps: DataFrame, model: BackoffModel, lower: bool = False) -> DataFrame:
    """(sent_id, hyp_id, lm, n_words) of (sent_id, hyp_id, text): base-10 log-probability of each text as a sentence, by its words."""
    from ..sources.corpus import marked

    text = F.lower("text") if lower else F.col("text")
    words = hyps.select("sent_id", "hyp_id", marked(F.array_remove(F.split(text, r"\s+"), "")).alias("words"))
    at = words.select("sent_id", "hyp_id", (F.size("words") - 2).alias("n_words"), "words", F.explode(F.sequence(F.lit(2), F.size("words"))).alias("i"))
    first = F.greatest(F.lit(1), F.col("i") - model.order + 1)
    grams = at.select("sent_id", "hyp_id", "n_words", F.reverse(F.slice("words", first, F.col("i") - first)).alias("ctx"), F.get("words", F.col("i") - 1).alias("w0"))
    return model.prob(grams, "p").groupBy("sent_id", "hyp_id", "n_words").agg(F.sum(F.log10("p")).alias("lm"))

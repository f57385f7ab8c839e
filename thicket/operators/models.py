"""Pruning of back-off models, generation, classes, and segment-wise models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import uniform32
from ..sources.corpus import BEGIN, END
from ..sources.tables import written
from .smoothing import BackoffModel


def entropy_prune(probs: DataFrame, threshold: float) -> DataFrame:
    """`probs` (ctx, w0, p, p_low, p_ctx) with delta and kept (Stolcke 1998).

    delta is the relative rise of the perplexity if the n-gram alone goes and its context's back-off weight is set anew;
    kept is delta >= threshold.  p_low is the shorter context's probability, p_ctx the context's own.  One aggregate by
    context, joined back.
    """
    sums = probs.groupBy("ctx").agg((1 - F.sum("p")).alias("__a"), (1 - F.sum("p_low")).alias("__b"))
    a, b, p, low = F.col("__a"), F.col("__b"), F.col("p"), F.col("p_low")
    new = F.log((F.greatest(a, F.lit(0.0)) + p) / (F.greatest(b, F.lit(0.0)) + low))
    passed_on = F.when((a > 1e-12) & (b > 1e-12), a * (new - F.log(a / b))).otherwise(0.0)
    delta = F.exp(-F.col("p_ctx") * (p * (F.log(low) + new - F.log(p)) + passed_on)) - 1
    return probs.join(sums, "ctx").withColumn("delta", delta).withColumn("kept", F.col("delta") >= threshold).select(*probs.columns, "delta", "kept")


def generate(bigrams: DataFrame, n: int, seed: int, longest: int = 50) -> DataFrame:
    """(sent_id, place, word) of `n` random sentences from (h1, w0, weight); the draw depends on seed, sentence and place alone.

    A step joins each open sentence to its last word's row of the cumulated weights, whose length the vocabulary bounds.
    A sentence ends with its END, after `longest` words, or where its last word has no followers.
    """
    spark = bigrams.sparkSession
    by_word = Window.partitionBy("h1").orderBy("w0")
    steps = bigrams.filter("weight > 0").select("h1", F.struct(F.sum("weight").over(by_word).alias("hi"), "w0").alias("x"))
    table = written(steps.groupBy("h1").agg(F.sort_array(F.collect_list("x")).alias("xs")))
    now = spark.range(n).select(F.col("id").alias("sent_id"), F.lit(BEGIN).alias("h1"))
    found = now.select("sent_id", F.lit(0).alias("place"), F.col("h1").alias("word")).filter(F.lit(False))
    for place in range(1, longest + 1):
        drawn = uniform32(seed, F.col("sent_id"), place) * F.element_at("xs", -1)["hi"] / float(1 << 32)
        step = now.join(table, "h1").withColumn("u", drawn).select("sent_id", F.element_at(F.filter("xs", lambda x: x["hi"] > F.col("u")), 1)["w0"].alias("h1"))
        step = written(step)
        found = found.unionByName(step.select("sent_id", F.lit(place).alias("place"), F.col("h1").alias("word")))
        now = step.filter(F.col("h1") != END)
        if now.isEmpty():
            break
    return found


def class_counts(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """Counts with each word replaced by its class from (word, class); words without one stand for themselves."""
    words = counts.withColumn("__id", F.monotonically_increasing_id()).select("__id", "ord", "cnt", F.posexplode(F.concat(F.array("w0"), "ctx")).alias("at", "word"))
    mapped = words.join(classes.select("word", "class"), "word", "left").withColumn("c", F.coalesce("class", "word"))
    whole = mapped.groupBy("__id", "ord", "cnt").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]).alias("cs"))
    return whole.select("ord", F.expr("slice(cs, 2, size(cs) - 1)").alias("ctx"), F.get("cs", F.lit(0)).alias("w0"), "cnt").groupBy("ord", "ctx", "w0").agg(F.sum("cnt").alias("cnt"))


def membership(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """(word, class, share): a word's share of its class's count, over the words of `counts` of order 1."""
    words = counts.filter(F.col("ord") == 1).select(F.col("w0").alias("word"), "cnt").join(classes.select("word", "class"), "word", "left")
    one = words.select("word", F.coalesce("class", "word").alias("class"), "cnt")
    total = one.groupBy("class").agg(F.sum("cnt").alias("n"))
    return one.join(total, "class").select("word", "class", (F.col("cnt") / F.col("n")).alias("share"))


def dynamic_mix(scored: DataFrame, unigrams: DataFrame, lam: float, segment: str = "segment") -> DataFrame:
    """`scored` (segment, w0, p) with prob: lam of the segment's own unigram p_dyn, the rest of p; a missing unigram gives 0."""
    own = unigrams.select(segment, F.col("w0").alias("__w"), "p_dyn")
    joined = scored.join(own.withColumnRenamed(segment, "__s"), (F.col(segment).eqNullSafe(F.col("__s"))) & (F.col("w0") == F.col("__w")), "left")
    return joined.withColumn("prob", lam * F.coalesce("p_dyn", F.lit(0.0)) + (1 - lam) * F.col("p")).select(*scored.columns, "prob")


def without_words(sentences: DataFrame, noise: list[str], backwards: bool = False) -> DataFrame:
    """Sentences less their noise words; `backwards` turns the words between the markers around."""
    kept = F.filter("words", lambda w: ~w.isin(*noise)) if noise else F.col("words")
    turned = F.transform(F.reverse(kept), lambda w: F.when(w == BEGIN, END).when(w == END, BEGIN).otherwise(w))
    return sentences.withColumn("words", turned if backwards else kept)


def backoff_lookup(grams: DataFrame, arpa: DataFrame, order: int, out: str = "logp", zero: float = -99.0) -> DataFrame:
    """`grams` (ctx, w0) with the log10 probability by an explicit model (ord, ctx, w0, logp, log_bow).

    The longest n-gram that the model lists counts, plus the back-off weights of the contexts that were too long; a context
    without a weight has weight 1.  A word without a unigram gets `zero`, whatever its context.
    """
    df = grams.join(arpa.filter("ord = 1").select(F.col("w0").alias("__w"), F.col("logp").alias("__p")), F.col("w0") == F.col("__w"), "left").select(*grams.columns, "__p")
    for k in range(2, order + 1):
        at = df.withColumn("__k", F.when(F.size("ctx") >= k - 1, F.slice("ctx", 1, k - 1)))
        listed = arpa.filter(F.col("ord") == k).select(F.col("ctx").alias("__c"), F.col("w0").alias("__w"), F.col("logp").alias("__own"))
        weights = arpa.filter((F.col("ord") == k - 1) & F.col("log_bow").isNotNull()).select(F.concat(F.array("w0"), "ctx").alias("__b"), "log_bow")
        at = at.join(listed, (F.col("__k") == F.col("__c")) & (F.col("w0") == F.col("__w")), "left").join(weights, F.col("__k") == F.col("__b"), "left")
        df = at.withColumn("__p", F.coalesce("__own", F.col("__p") + F.coalesce("log_bow", F.lit(0.0)))).select(*grams.columns, "__p")
    return df.select(*grams.columns, F.coalesce("__p", F.lit(zero)).alias(out))


def rescore(arpa: DataFrame, model: BackoffModel) -> DataFrame:
    """The n-grams of an explicit model with another model's probabilities: (ord, ctx, w0, logp, log_bow), weights as they were."""
    scored = model.prob(arpa.drop("logp"), "p")
    return scored.select("ord", "ctx", "w0", F.log10(F.when(F.col("p") > 0, F.col("p"))).alias("logp"), "log_bow")


def skip_step(scored: DataFrame, weights: DataFrame | None = None, start: float = 0.5) -> DataFrame:
    """(word, weight): one EM step for the chance that the newest word of a context is skipped, by that word.

    `scored` has (word, cnt, p_keep, p_skip); words that `weights` lacks begin with `start`.
    """
    df = scored.join(weights, "word", "left") if weights is not None else scored.withColumn("weight", F.lit(start))
    lam = F.coalesce("weight", F.lit(start))
    post = lam * F.col("p_skip") / (lam * F.col("p_skip") + (1 - lam) * F.col("p_keep"))
    return df.groupBy("word").agg((F.sum(F.col("cnt") * post) / F.sum("cnt")).alias("weight"))


def null_probs(grams: DataFrame, out: str = "p") -> DataFrame:
    """The null model: every word has probability 1."""
    return grams.withColumn(out, F.lit(1.0))

"""The engine's queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import uniform32
from ..operators import counts as C
from ..operators import discounts as K
from ..operators import evaluate as E
from ..operators import forest as T
from ..operators import lifecycle as L
from ..operators import models as M
from ..operators import smoothing as S
from ..operators import split
from ..sources import corpus, formats
from ..sources.tables import written
from ..streaming.scorer import score_stream

ORDER, VOCABULARY, SEED = 3, 500, 7
#: A fixed tree over the events' word ids, for operators on given trees.
TREE = [(0, "", "0", 0, w) for w in (1, 2, 3)] + [(0, "", "1", 0, w) for w in (4, 5)] + [(0, "0", "00", 1, w) for w in (1, 2)] + [(0, "0", "01", 1, w) for w in (3, 4, 5)]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return corpus.event_sentences(_table(spark, d, "events"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return C.ngram_counts(_sentences(spark, d), ORDER)


def _docs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sentences of all documents over the most frequent words, and those words."""
    sentences = corpus.text_sentences(_table(spark, d, "documents"))
    vocab = written(corpus.vocabulary(sentences, VOCABULARY))
    return corpus.map_unknown(sentences, vocab), vocab


def _all_words(spark: SparkSession, d: str) -> DataFrame:
    """Counts over the sentences of all documents, with every word as it is: no vocabulary is given."""
    return C.ngram_counts(corpus.text_sentences(_table(spark, d, "documents")), ORDER)


def _flat(df: DataFrame, *more: str | Column) -> DataFrame:
    """ctx as columns h1 (newest) and h2."""
    return df.select("ord", F.get("ctx", F.lit(0)).alias("h1"), F.get("ctx", F.lit(1)).alias("h2"), *more)


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    """Trigrams (ctx, w0, cnt) of the events in word ids."""
    sentences = _sentences(spark, d)
    ids = written(corpus.word_ids(sentences))
    top = C.ngram_counts(sentences, ORDER).filter(F.col("ord") == ORDER)
    named = top.select(F.get("ctx", F.lit(0)).alias("a"), F.get("ctx", F.lit(1)).alias("b"), F.col("w0").alias("c"), "cnt")
    for k in "abc":
        named = named.join(ids.select(F.col("word").alias(k), F.col("wid").alias(f"{k}_id")), k)
    return named.select(F.array("a_id", "b_id").alias("ctx"), F.col("c_id").alias("w0"), "cnt")


def _at_root(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tree_id", F.lit(0)).withColumn("path", F.lit(""))


def _classified(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = spark.createDataFrame(TREE, T.EDGES)
    return T.classify(_encoded(spark, d).withColumn("tree_id", F.lit(0)), edges, 2), edges


@query
def ngram_counts_docs(spark: SparkSession, d: str) -> DataFrame:
    return _flat(C.ngram_counts(_docs(spark, d)[0], ORDER), "w0", "cnt")


@query
def ngram_counts_all_words(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_all_words(spark, d), "w0", "cnt")


@query
def ngram_counts_events(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_counts(spark, d), "w0", "cnt")


@query
def ngram_min_counts(spark: SparkSession, d: str) -> DataFrame:
    return _flat(C.min_counts(_counts(spark, d), {2: 20, 3: 100}), "w0", "cnt")


@query
def merge_counts(spark: SparkSession, d: str) -> DataFrame:
    names = corpus.text_sentences(_table(spark, d, "part"), "p_name")
    return _flat(C.merge(_counts(spark, d), C.ngram_counts(names, ORDER)), "w0", "cnt")


@query
def recompute_lower(spark: SparkSession, d: str) -> DataFrame:
    return _flat(C.recompute(_counts(spark, d), 2), "w0", "cnt")


@query
def test_counts_mode(spark: SparkSession, d: str) -> DataFrame:
    return _flat(C.test_counts(_counts(spark, d), ORDER), "w0", "cnt")


@query
def count_file_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _flat(corpus.read_counts(corpus.count_lines(_counts(spark, d))), "w0", "cnt")


@query
def vocab_topk(spark: SparkSession, d: str) -> DataFrame:
    return corpus.vocabulary(corpus.text_sentences(_table(spark, d, "documents")), VOCABULARY)


@query
def oov_map(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d)[0].select(F.explode("words").alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query
def nonevent_filter(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_counts(spark, d).filter(F.col("w0") != corpus.BEGIN), "w0", "cnt")


@query
def counts_of_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.counts_of_counts(C.ngram_counts(_docs(spark, d)[0], ORDER))


@query
def counts_of_counts_all_words(spark: SparkSession, d: str) -> DataFrame:
    return C.counts_of_counts(_all_words(spark, d))


@query
def kn_continuation(spark: SparkSession, d: str) -> DataFrame:
    return _flat(C.continuation(_counts(spark, d), ORDER), "w0", "cnt")


@query
def kn_discounts(spark: SparkSession, d: str) -> DataFrame:
    found = S.discount_columns(C.counts_of_counts(C.ngram_counts(_docs(spark, d)[0], ORDER)))
    return found.select("ord", *(F.round(c, 6).alias(c) for c in ("y", "d1", "d2", "d3")))


@query
def kn_discounts_all_words(spark: SparkSession, d: str) -> DataFrame:
    found = S.discount_columns(C.counts_of_counts(_all_words(spark, d)))
    return found.select("ord", *(F.round(c, 6).alias(c) for c in ("y", "d1", "d2", "d3")))


@query
def context_stats(spark: SparkSession, d: str) -> DataFrame:
    return _flat(C.context_stats(_counts(spark, d)), "total", "types", "min2", "min3")


def _wb(spark: SparkSession, d: str) -> DataFrame:
    counts = written(_counts(spark, d))
    model = S.train(counts, ORDER, "witten-bell")
    test = counts.filter((F.col("ord") == ORDER) & (F.col("w0") != corpus.BEGIN)).select("ord", "ctx", "w0", "cnt")
    return model.prob(test)


@query
def wb_trigram_prob(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_wb(spark, d), "w0", F.round("p", 6).alias("p"))


@query
def wb_perplexity(spark: SparkSession, d: str) -> DataFrame:
    found = E.perplexity(_wb(spark, d), "p")
    return found.select("sentences", "words", "zeroprobs", *(F.round(c, 4).alias(c) for c in ("logprob", "ppl", "ppl1")))


@query
def kn_perplexity(spark: SparkSession, d: str) -> DataFrame:
    counts = written(_all_words(spark, d))
    model = S.train(counts, ORDER)
    test = C.test_counts(counts, ORDER).filter(F.col("w0") != corpus.BEGIN)
    return E.perplexity(model.prob(test), "p")


@query
def kn_normalisation(spark: SparkSession, d: str) -> DataFrame:
    """The probabilities of all words behind each seen context of the events add up to 1."""
    counts = written(_counts(spark, d))
    model = S.train(counts, ORDER)
    words = counts.filter((F.col("ord") == 1) & (F.col("w0") != corpus.BEGIN)).agg(F.collect_set("w0").alias("ws"))
    contexts = counts.filter((F.col("ord") == ORDER) & (F.col("w0") != corpus.BEGIN)).select("ord", "ctx").distinct()
    grams = contexts.join(F.broadcast(words)).select("ord", "ctx", F.explode("ws").alias("w0"))
    return _flat(model.prob(grams).groupBy("ord", "ctx").agg(F.round(F.sum("p"), 6).alias("total_p")), "total_p")


@query
def wb_backoff_weights(spark: SparkSession, d: str) -> DataFrame:
    counts = written(_counts(spark, d))
    model = S.train(counts, 2, "witten-bell")
    grams = counts.filter((F.col("ord") == 2) & (F.col("w0") != corpus.BEGIN)).select("ctx", "w0")
    lower = S.train(counts, 1, "witten-bell")
    bows = S.backoff_weights(lower.prob(model.prob(grams), "p_low"))
    return bows.select(F.get("ctx", F.lit(0)).alias("h1"), F.round("bow", 6).alias("bow"))


@query
def arpa_round_trip(spark: SparkSession, d: str) -> DataFrame:
    scored = _wb(spark, d)
    bows = scored.select("ctx").distinct().withColumn("bow", F.lit(1.0))
    return _flat(formats.read_arpa(formats.arpa_lines(scored.select("ord", "ctx", "w0", "p"), bows)), "w0", F.round("logp", 4).alias("logp"))


@query
def stream_score(spark: SparkSession, d: str) -> DataFrame:
    counts = written(_counts(spark, d))
    asked = counts.filter((F.col("ord") == 2) & (F.col("w0") != corpus.BEGIN)).select("ord", "ctx", "w0")
    return _flat(score_stream(asked, S.train(counts, ORDER, "witten-bell")), "w0", F.round("p", 6).alias("p"))


@query
def split_elements(spark: SparkSession, d: str) -> DataFrame:
    return split.elements(_at_root(_encoded(spark, d)), range(2)).select("pos", "elem", "w0", "cnt")


@query
def element_type_stats(spark: SparkSession, d: str) -> DataFrame:
    return split.element_stats(split.elements(_at_root(_encoded(spark, d)), range(2))).drop("tree_id", "path")


@query
def parity_split_gain(spark: SparkSession, d: str) -> DataFrame:
    elems = split.elements(_at_root(_encoded(spark, d)), range(2))
    return split.split_gain(elems, F.col("elem") % 2).select("pos", F.round("gain", 4).alias("gain"))


@query
def random_sides(spark: SparkSession, d: str) -> DataFrame:
    elems = split.elements(_at_root(_encoded(spark, d)), range(2)).select("pos", "elem").distinct()
    return elems.select("pos", "elem", (uniform32(SEED, 0, "", F.col("pos"), F.col("elem"), 0) % 2).alias("side"))


@query
def position_sample(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.range(100).select(F.col("id").alias("tree_id"), F.lit("").alias("path"), F.lit(0).alias("attempt")).crossJoin(spark.range(2).select(F.col("id").alias("pos")))
    return grid.select("tree_id", "pos", split.position_kept(SEED, 0.5).alias("kept"))


@query
def exchange_split(spark: SparkSession, d: str) -> DataFrame:
    elems = split.elements(_at_root(_encoded(spark, d)), range(2))
    return split.search(elems, SEED, "none").select("pos", "elem", "side", F.round("gain", 4).alias("gain"))


@query
def tree_classify(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = _classified(spark, d)
    return rows.select(F.get("ctx", F.lit(0)).alias("h1"), F.get("ctx", F.lit(1)).alias("h2"), "w0", "cnt", "path", "found")


@query
def leaf_histogram(spark: SparkSession, d: str) -> DataFrame:
    return T.leaf_histogram(_classified(spark, d)[0]).drop("tree_id")


@query
def leaf_stats(spark: SparkSession, d: str) -> DataFrame:
    return T.leaf_stats(T.leaf_histogram(_classified(spark, d)[0])).drop("tree_id")


@query
def tree_word_prob(spark: SparkSession, d: str) -> DataFrame:
    """Leaf probabilities with an absolute discount and a uniform back-off; provenance as in an information dump."""
    rows, _ = _classified(spark, d)
    rows = written(rows.withColumn("p_short", F.lit(1 / 7)).withColumn("p_full", F.lit(1 / 7)).withColumn("short", F.lit(False)))
    found = T.score(rows, T.leaf_histogram(rows), S.Discount(d=(0.5, 0.75, 0.9)))
    return found.select(F.get("ctx", F.lit(0)).alias("h1"), F.get("ctx", F.lit(1)).alias("h2"), "w0", "provenance", F.round("prob", 6).alias("prob"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the fixed tree with the held-out sums of the rows that pass, and their log-likelihood under the node's shares."""
    rows, edges = _classified(spark, d)
    passing = rows.select("tree_id", F.explode(T.prefixes("path")).alias("path"), "w0", "cnt", "found")
    hist = passing.groupBy("tree_id", "path", "w0").agg(F.sum("cnt").alias("cnt"))
    share = F.col("cnt") / F.sum("cnt").over(Window.partitionBy("tree_id", "path"))
    sums = hist.withColumn("l", F.col("cnt") * F.log10(share)).groupBy("tree_id", "path").agg(F.sum("l").alias("logl"), F.sum("cnt").alias("heldout_sum"))
    return T.node_paths(edges).join(sums, ["tree_id", "path"])


@query
def heldout_loglikelihood(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("path", "is_leaf", F.round("logl", 3).alias("logl"), "heldout_sum")


@query
def node_potential(spark: SparkSession, d: str) -> DataFrame:
    return T.potentials(_nodes(spark, d)).select("path", F.round("potential", 6).alias("potential"))


@query
def prune_nodes(spark: SparkSession, d: str) -> DataFrame:
    return T.prune(T.potentials(_nodes(spark, d)), 0.01).select("path", "is_leaf")


@query
def tree_stats(spark: SparkSession, d: str) -> DataFrame:
    return T.tree_stats(spark.createDataFrame(TREE, T.EDGES))


@query
def tree_file_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The tree by parity of the events' word ids, to text and back: every node's line is read by itself."""
    lines = formats.tree_lines(_life(spark, d)[2])
    return formats.tree_paths(lines).select("parent", "child", "pos", "word")


@query
def forest_growth(spark: SparkSession, d: str) -> DataFrame:
    """A random forest on the events: its size by tree."""
    return T.tree_stats(T.grow(written(_encoded(spark, d)), 3, ORDER, SEED))


@query
def forest_perplexity(spark: SparkSession, d: str) -> DataFrame:
    """Grown trees score all trigrams, are mixed, and the mix is evaluated on the same counts."""
    train = written(_encoded(spark, d))
    edges = written(T.grow(train, 3, ORDER, SEED))
    depth = edges.agg(F.max(F.length("child"))).first()[0] or 0
    ids = edges.select("tree_id").distinct()
    rows = T.classify(train.join(F.broadcast(ids)), edges, depth)
    rows = written(rows.withColumn("p_short", F.lit(1 / 7)).withColumn("p_full", F.lit(1 / 7)).withColumn("short", F.lit(False)))
    scored = T.score(rows, T.leaf_histogram(rows), S.Discount())
    mixed = E.mix(scored.select("tree_id", "ctx", "w0", "cnt", "prob"), keys=("ctx", "w0", "cnt"))
    return E.perplexity(mixed.withColumn("w0", F.col("w0").cast("string")), end="none")


def _two_models(spark: SparkSession, d: str) -> DataFrame:
    counts = written(_counts(spark, d))
    grams = counts.filter((F.col("ord") == ORDER) & (F.col("w0") != corpus.BEGIN)).select("ord", "ctx", "w0", "cnt")
    return S.train(counts, 1, "witten-bell").prob(S.train(counts, ORDER, "witten-bell").prob(grams, "p1"), "p2")


@query
def mix_uniform(spark: SparkSession, d: str) -> DataFrame:
    both = _two_models(spark, d).select("ord", "ctx", "w0", F.explode(F.array("p1", "p2")).alias("prob"))
    return _flat(E.mix(both, keys=("ord", "ctx", "w0")), "w0", F.round("prob", 6).alias("prob"))


@query
def em_lambda_step(spark: SparkSession, d: str) -> DataFrame:
    return E.em_step(_two_models(spark, d), F.lit(0.5)).select(F.round("lambda", 6).alias("lambda"))


def _event_probs(spark: SparkSession, d: str) -> DataFrame:
    events = _table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    share = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = share.agg(F.sum("n").alias("all"))
    p = share.join(F.broadcast(total)).select("event_type", (F.col("n") / F.col("all")).alias("p1"), F.lit(0.2).alias("p2"))
    return events.join(p, "event_type")


@query
def cache_lm(spark: SparkSession, d: str) -> DataFrame:
    found = E.cache_probs(_table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), 10, "user_id", ["ts", "event_id"], "event_type")
    return found.select("event_id", F.round("cache_p", 6).alias("cache_p"))


@query
def bayes_mix(spark: SparkSession, d: str) -> DataFrame:
    return E.bayes_mix(_event_probs(spark, d), 3, 1.0, "user_id", ["ts", "event_id"]).select("event_id", F.round("prob", 6).alias("prob"))


@query
def nbest_rescore(spark: SparkSession, d: str) -> DataFrame:
    lines = _table(spark, d, "lineitem")
    hyps = lines.select(F.col("l_orderkey").alias("sent_id"), F.col("l_linenumber").alias("hyp_id"), (-F.col("l_quantity")).alias("ac"), (-F.col("l_discount") * 100).alias("lm"), F.col("l_linenumber").alias("n_words"))
    return E.nbest(hyps, 0.5, 0.25).select("sent_id", "hyp_id", F.round("total", 4).alias("total"), "rank")


@query
def adapt_marginals(spark: SparkSession, d: str) -> DataFrame:
    wb = _wb(spark, d).select("ctx", "w0", F.col("p").alias("prob"))
    base = _counts(spark, d).filter((F.col("ord") == 1) & (F.col("w0") != corpus.BEGIN)).select("w0", F.col("cnt").cast("double").alias("pb"))
    found = E.adapt_marginals(wb, base, base.select("w0", F.sqrt("pb")), 0.5)
    return found.select(F.get("ctx", F.lit(0)).alias("h1"), F.get("ctx", F.lit(1)).alias("h2"), "w0", F.round("prob", 6).alias("prob"))


@query
def good_turing_discounts(spark: SparkSession, d: str) -> DataFrame:
    return K.good_turing(C.ngram_counts(_docs(spark, d)[0], ORDER)).select("ord", "r", "n_r", F.round("factor", 6).alias("factor"))


@query
def good_turing_discounts_all_words(spark: SparkSession, d: str) -> DataFrame:
    return K.good_turing(_all_words(spark, d)).select("ord", "r", "n_r", F.round("factor", 6).alias("factor"))


def _seen_contexts(counts: DataFrame, order: int) -> DataFrame:
    """Each seen context of an order with every word: the events' vocabulary is six words."""
    words = counts.filter((F.col("ord") == 1) & (F.col("w0") != corpus.BEGIN)).agg(F.collect_set("w0").alias("ws"))
    contexts = counts.filter((F.col("ord") == order) & (F.col("w0") != corpus.BEGIN)).select("ord", "ctx").distinct()
    return contexts.join(F.broadcast(words)).select("ord", "ctx", F.explode("ws").alias("w0"))


@query
def good_turing_normalisation(spark: SparkSession, d: str) -> DataFrame:
    """Good-Turing probabilities of all words behind each seen context of the events add up to 1."""
    counts = written(_counts(spark, d).filter(F.col("w0") != corpus.BEGIN))
    probs = K.good_turing_probs(_seen_contexts(counts, ORDER), counts, ORDER, counts.filter("ord = 1").count())
    return _flat(probs.groupBy("ord", "ctx").agg(F.round(F.sum("p"), 6).alias("total_p")), "total_p")


@query
def natural_bigram_prob(spark: SparkSession, d: str) -> DataFrame:
    counts = written(_counts(spark, d))
    return _flat(K.train_natural(counts, 2).prob(_seen_contexts(counts, 2)), "w0", F.round("p", 6).alias("p"))


@query
def tagged_context_stats(spark: SparkSession, d: str) -> DataFrame:
    """Each context's followers as counts of counts."""
    tagged = _counts(spark, d).groupBy("ord", "ctx", F.concat(F.lit("__meta__"), "cnt").alias("w0")).agg(F.count(F.lit(1)).alias("cnt"))
    return _flat(K.tagged_stats(tagged, "__meta__"), "total", "types", "min2", "min3")


@query
def entropy_prune(spark: SparkSession, d: str) -> DataFrame:
    counts = written(_counts(spark, d).filter(F.col("w0") != corpus.BEGIN))
    grams = counts.filter("ord = 2")
    both = S.train(counts, 1, "witten-bell").prob(S.train(counts, 2, "witten-bell").prob(grams), "p_low")
    share = grams.groupBy("ctx").agg(F.sum("cnt").alias("n"))
    all_n = share.agg(F.sum("n").alias("all"))
    weighed = both.join(share, "ctx").join(F.broadcast(all_n)).select("ctx", "w0", "p", "p_low", (F.col("n") / F.col("all")).alias("p_ctx"))
    return M.entropy_prune(weighed, 1e-4).select(F.get("ctx", F.lit(0)).alias("h1"), "w0", F.round("delta", 6).alias("delta"), "kept")


@query
def generate_sentences(spark: SparkSession, d: str) -> DataFrame:
    bigrams = C.ngram_counts(corpus.text_sentences(_table(spark, d, "part"), "p_name"), 2).filter("ord = 2")
    return M.generate(bigrams.select(F.get("ctx", F.lit(0)).alias("h1"), "w0", F.col("cnt").alias("weight")), 20, SEED, 8)


def _event_classes(spark: SparkSession, d: str) -> DataFrame:
    types = _table(spark, d, "events").select(F.col("event_type").alias("word")).distinct()
    return types.withColumn("class", F.concat(F.lit("C"), (F.length("word") % 2).cast("string")))


@query
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return _flat(M.class_counts(_counts(spark, d), _event_classes(spark, d)), "w0", "cnt")


@query
def class_membership(spark: SparkSession, d: str) -> DataFrame:
    return M.membership(_counts(spark, d), _event_classes(spark, d)).select("word", "class", F.round("share", 6).alias("share"))


@query
def dynamic_lm(spark: SparkSession, d: str) -> DataFrame:
    """Each user's own event shares, mixed with those of all.  Ten digits: shares of whole counts often end in 5 at the seventh."""
    probs = _event_probs(spark, d).select("event_id", F.col("user_id").alias("segment"), F.col("event_type").alias("w0"), F.col("p1").alias("p"))
    n = probs.groupBy("segment", "w0").agg(F.count(F.lit(1)).alias("n"))
    own = n.join(n.groupBy("segment").agg(F.sum("n").alias("all")), "segment").select("segment", "w0", (F.col("n") / F.col("all")).alias("p_dyn"))
    return M.dynamic_mix(probs, own, 0.3).select("event_id", F.round("prob", 10).alias("prob"))


@query
def noise_and_reverse(spark: SparkSession, d: str) -> DataFrame:
    quiet = M.without_words(_sentences(spark, d), ["error", "view"], True)
    return _flat(C.ngram_counts(quiet, ORDER), "w0", "cnt")


@query
def shallow_growth(spark: SparkSession, d: str) -> DataFrame:
    """Trees that try three nodes each."""
    return T.tree_stats(T.grow(written(_encoded(spark, d)), 3, ORDER, SEED, max_nodes=3))


@query
def arpa_backoff_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A bigram model that lists the words before p only; the others back off."""
    counts = written(_counts(spark, d))
    uni, bi = S.train(counts, 1, "witten-bell"), S.train(counts, 2, "witten-bell")
    grams = _seen_contexts(counts, 2)
    listed = uni.prob(bi.prob(counts.filter("ord = 2 and w0 < 'p'").filter(F.col("w0") != corpus.BEGIN).select("ord", "ctx", "w0")), "p_low")
    bows = S.backoff_weights(listed).select("ctx", F.log10("bow").alias("log_bow"))
    words = uni.prob(counts.filter("ord = 1").select("ord", "ctx", "w0"))
    ones = words.select("ord", "ctx", "w0", F.log10("p").alias("logp")).join(bows.select(F.get("ctx", F.lit(0)).alias("w0"), "log_bow"), "w0", "left")
    arpa = ones.unionByName(listed.select("ord", "ctx", "w0", F.log10("p").alias("logp"), F.lit(None).cast("double").alias("log_bow")))
    return _flat(M.backoff_lookup(grams, written(arpa), 2), "w0", F.round("logp", 4).alias("logp"))


@query
def rescore_ngrams(spark: SparkSession, d: str) -> DataFrame:
    counts = written(_counts(spark, d))
    flat = counts.filter((F.col("ord") == ORDER) & (F.col("w0") != corpus.BEGIN)).select("ord", "ctx", "w0", F.lit(-1.0).alias("logp"), F.lit(0.0).alias("log_bow"))
    return _flat(M.rescore(flat, S.train(counts, ORDER, "witten-bell")), "w0", F.round("logp", 4).alias("logp"))


@query
def skip_weights(spark: SparkSession, d: str) -> DataFrame:
    counts = written(_counts(spark, d))
    grams = counts.filter((F.col("ord") == ORDER) & (F.col("w0") != corpus.BEGIN)).select("ctx", "w0", "cnt")
    kept = S.train(counts, ORDER, "witten-bell").prob(grams, "p_keep")
    older = kept.select(F.get("ctx", F.lit(0)).alias("word"), F.slice("ctx", 2, 1).alias("ctx"), "w0", "cnt", "p_keep")
    return M.skip_step(S.train(counts, 2, "witten-bell").prob(older, "p_skip")).select("word", F.round("weight", 6).alias("weight"))


#: Of ten parts of the events' sentences, those that are held out, and those that test.
HELD_PARTS, TEST_PARTS = (7, 8), (9,)
#: Held-out gain up to which a subtree goes before it scores: below 0, for the events have no structure that a tree could gain by.
PRUNE = -0.001


def _apart(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], int]:
    """Counts in word ids of the sentences for training, held out and for testing; and the id of the begin mark."""
    sentences = written(corpus.parted(_sentences(spark, d), SEED))  # read for the ids and by each part
    ids = written(corpus.word_ids(sentences))
    part = F.col("part")
    where = {"train": ~part.isin(*HELD_PARTS, *TEST_PARTS), "held": part.isin(*HELD_PARTS), "test": part.isin(*TEST_PARTS)}
    counts = {k: written(corpus.coded(C.ngram_counts(sentences.filter(v).select("words"), ORDER), ids)) for k, v in where.items()}
    return counts, ids.filter(F.col("word") == corpus.BEGIN).first()["wid"]


def _top(counts: DataFrame, begin: int) -> DataFrame:
    return counts.filter((F.col("ord") == ORDER) & (F.col("w0") != begin)).select("ctx", "w0", "cnt")


def _parity_tree(top: DataFrame) -> DataFrame:
    """A tree whose root asks for the newest word's id modulo 2, and whose children ask the same of half the older one's."""
    side = (F.get("ctx", F.lit(0)) % 2).cast("string")
    below = F.concat(side, (F.floor(F.get("ctx", F.lit(1)) / 2) % 2).cast("string"))
    first = top.select(F.lit(0).alias("tree_id"), F.lit("").alias("parent"), side.alias("child"), F.lit(0).alias("pos"), F.get("ctx", F.lit(0)).alias("word"))
    second = top.select(F.lit(0).alias("tree_id"), side.alias("parent"), below.alias("child"), F.lit(1).alias("pos"), F.get("ctx", F.lit(1)).alias("word"))
    return first.unionByName(second).distinct()


def _life(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], int, DataFrame, S.BackoffModel]:
    """Counts apart, the begin mark, the parity tree of the training counts, and a Witten-Bell model of them."""
    counts, begin = _apart(spark, d)
    return counts, begin, written(_parity_tree(_top(counts["train"], begin))), S.train(counts["train"], ORDER, "witten-bell", (begin,))


def _life_nodes(counts: dict[str, DataFrame], begin: int, edges: DataFrame, model: S.BackoffModel) -> DataFrame:
    held = written(L.backed_off(_top(counts["held"], begin), model, ORDER))
    return written(L.measure(edges, _top(counts["train"], begin), held, S.Discount()))


@query
def heldout_node_loglikelihood(spark: SparkSession, d: str) -> DataFrame:
    """Held-out log-likelihood of every node under its own discounted counts and the back-off model; text apart from training."""
    return _life_nodes(*_life(spark, d)).select("path", "is_leaf", F.round("logl", 5).alias("logl"), "heldout_sum")


@query
def heldout_pruning(spark: SparkSession, d: str) -> DataFrame:
    counts, begin, edges, model = _life(spark, d)
    return L.pruned(edges, _life_nodes(counts, begin, edges, model))[1].select("path", "is_leaf", F.round("potential", 6).alias("potential"))


def _life_scores(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, DataFrame], int, S.BackoffModel]:
    """Test n-grams scored by the pruned parity tree, its leaves filled with training and held-out counts."""
    counts, begin, edges, model = _life(spark, d)
    kept = written(L.pruned(edges, _life_nodes(counts, begin, edges, model), PRUNE)[0])
    test = L.backed_off(L.scorable(counts["test"], ORDER, begin), model, ORDER)
    filling = C.merge(counts["train"], counts["held"])
    trees = spark.range(1).select(F.col("id").cast("int").alias("tree_id"))
    return written(L.score(test, _top(filling, begin), kept, trees, S.Discount(), ORDER)), counts, begin, model


@query
def lifecycle_scores(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_life_scores(spark, d)[0], "w0", "cnt", "provenance", F.round("prob", 8).alias("prob"))


@query
def lifecycle_perplexity(spark: SparkSession, d: str) -> DataFrame:
    return L.perplexities(_life_scores(spark, d)[0], "none").select("model", F.round("ppl", 5).alias("ppl"))


@query
def lm_export(spark: SparkSession, d: str) -> DataFrame:
    """The scored test n-grams as an ARPA file, written, read back and looked up: what the forest says comes out again."""
    scored, counts, begin, model = _life_scores(spark, d)
    tested = written(scored.filter(F.col("ord") == ORDER))
    whole = written(L.exported(tested, model, counts["test"], ORDER, begin, -1))
    path = f"{whole.written_to}_arpa"
    formats.write_lines(formats.arpa_file(whole), path)
    back = formats.read_arpa(spark.read.text(path))
    grams = tested.select("ord", F.expr("transform(ctx, w -> cast(w as string))").alias("ctx"), F.col("w0").cast("string").alias("w0"))
    found = M.backoff_lookup(grams, written(back), ORDER)
    return found.select("ord", *(F.get("ctx", F.lit(k)).cast("long").alias(f"h{k + 1}") for k in (0, 1)), F.col("w0").cast("long").alias("w0"), F.round("logp", 6).alias("logp"))


@query
def forest_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Kneser-Ney, each grown and pruned tree, and the forest on the events' test sentences: (model, ppl)."""
    counts, begin = _apart(spark, d)
    model = S.train(counts["train"], ORDER, "modified", (begin,))
    held = written(L.backed_off(_top(counts["held"], begin), model, ORDER))
    edges, nodes = T.grow_measured(_top(counts["train"], begin), held, 5, ORDER, SEED, S.Discount())
    kept = written(L.pruned(written(edges), written(nodes), PRUNE)[0])
    test = written(L.backed_off(L.scorable(counts["test"], ORDER, begin), model, ORDER))
    trees = spark.range(5).select(F.col("id").cast("int").alias("tree_id"))
    scored = written(L.score(test, _top(C.merge(counts["train"], counts["held"]), begin), kept, trees, S.Discount(), ORDER))
    kn = test.select(F.lit("kneser-ney").alias("model"), (F.col("cnt") * F.log10("p_full")).alias("l"), "cnt").groupBy("model").agg(F.pow(F.lit(10.0), -F.sum("l") / F.sum("cnt")).alias("ppl"))
    return L.perplexities(scored, "none").unionByName(kn)


@query
def discount_files(spark: SparkSession, d: str) -> DataFrame:
    """Modified Kneser-Ney discounts over continuation counts, of n-grams seen so often or more, written as files and read back."""
    counts = C.continuation(written(C.ngram_counts(_docs(spark, d)[0], ORDER).filter(F.col("w0") != corpus.BEGIN)), ORDER)
    found = S.discount_columns(C.counts_of_counts(C.min_counts(counts, {})))
    lines = written(formats.discount_lines(found.withColumn("mincount", F.lit(1)).filter("d1 is not null and d2 is not null and d3 is not null")))
    return formats.read_discounts(lines).select("ord", "mincount", *(F.round(c, 6).alias(c) for c in ("d1", "d2", "d3")))


@query
def ngram_dump(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities of given lines, in their order: the events' trigrams, numbered by how often they occur."""
    counts = written(_counts(spark, d))
    top = counts.filter((F.col("ord") == ORDER) & (F.col("w0") != corpus.BEGIN)).select(F.concat_ws(" ", F.reverse("ctx"), "w0").alias("value"), "cnt")
    lines = top.select((F.rank().over(Window.orderBy(F.col("cnt").desc(), "value"))).alias("line_no"), "value")
    return E.dump(lines, S.train(counts, ORDER, "witten-bell"))


@query
def cache_interpolated(spark: SparkSession, d: str) -> DataFrame:
    tokens = E.cache_probs(_event_probs(spark, d), 10, "user_id", ["ts", "event_id"], "event_type")
    return E.cache_mix(tokens, 0.1, "p1").select("event_id", F.round("prob", 6).alias("prob"))


@query
def bayes_mix_of_three(spark: SparkSession, d: str) -> DataFrame:
    """Three models with priors of their own."""
    probs = _event_probs(spark, d).withColumn("p3", F.when(F.col("event_type") == "view", 0.6).otherwise(0.1))
    found = E.bayes_mix(probs, 5, 0.5, "user_id", ["ts", "event_id"], ("p1", "p2", "p3"), (0.5, 0.3, 0.2))
    return found.select("event_id", F.round("prob", 6).alias("prob"))


@query
def static_interpolation(spark: SparkSession, d: str) -> DataFrame:
    both = E.interpolated(_two_models(spark, d), {"p1": 0.7, "p2": 0.3})
    return _flat(both, "w0", F.round("prob", 6).alias("prob"))


@query
def rescored_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """Part names as hypotheses of their brands: a bigram model of all names scores their words, and ranks the first ten of each brand."""
    parts = _table(spark, d, "part")
    counts = written(C.ngram_counts(corpus.text_sentences(parts, "p_name"), 2))
    hyps = parts.select(F.col("p_brand").alias("sent_id"), F.col("p_partkey").alias("hyp_id"), F.col("p_name").alias("text"))
    lm = E.rescore_lines(hyps, S.train(counts, 2, "witten-bell"))
    return E.nbest(lm.withColumn("ac", F.lit(0.0)), 1.0, 0.5, 10).select("sent_id", "hyp_id", F.round("total", 6).alias("total"))

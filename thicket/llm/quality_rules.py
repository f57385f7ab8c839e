"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio of trusted text to the raw corpus.

DataFrame and SQL functions only.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, small, written

#: Hash buckets of the multinomials: what the driver holds and sends out is so many numbers, whatever the corpus.
BUCKETS = 1 << 14
#: Bins of a histogram that the threshold is looked up in: rows that the driver receives at once.
BINS = 1 << 12
#: One trusted document in so many is left out of the target and sets the threshold.
HOLD_OUT = 5
#: Added to each count.
SMOOTHING = 1.0
#: The threshold is the score that this percentage of the trusted documents left out, those that pass the base rules, fall
#: below: so many good documents in a hundred may be lost.
LOST_PERCENT = 1
#: Base rules: fewest words, and most words in repeated windows as a percentage.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "[#*$%&|<>]"
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def _ngrams(words: Column) -> Column:
    """The bucket of each word, and of each word with the one before it; the first has an empty one before it."""
    bucket = lambda *w: F.pmod(F.xxhash64(*w), F.lit(BUCKETS)).cast("int")
    before = lambda i: F.when(i > 0, F.get(words, i - 1)).otherwise("")
    return F.concat(F.transform(words, lambda w: bucket(w)), F.transform(words, lambda w, i: bucket(w, before(i))))


def _repeated(windows: Column, ordered: Column) -> Column:
    """Words in windows that occur twice or more; `ordered` has (hash, place) of each window, sorted by hash."""
    same = lambda e, i: (e["h"] == F.get(ordered, i - 1)["h"]) | (e["h"] == F.get(ordered, i + 1)["h"])
    places = F.transform(F.filter(ordered, lambda e, i: F.coalesce(same(e, i), F.lit(False))), lambda e: e["p"])
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))


def measured(df: DataFrame) -> DataFrame:
    """`df` with `__words` and the counts of the base rules, from its column `__text`; each expression is computed once."""
    out = df.withColumn("__words", _words(F.col("__text")))
    window = lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2))
    whole = F.filter(F.col("__words"), lambda w, i: i < F.size("__words") - 2)
    out = out.withColumn("__windows", F.transform(whole, window))
    # only texts with a repeated window are sorted
    pairs = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    out = out.withColumn("__ordered", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), pairs))
    lines = F.filter(F.split(F.coalesce("__text", F.lit("")), "\n"), lambda x: x.rlike(_HAS_WORD))
    out = out.withColumn("__lines", lines)
    return out.select(
        *df.columns,
        "__words",
        F.size("__words").cast("long").alias("__n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("__word_chars"),
        (F.size(F.split(F.coalesce("__text", F.lit("")), _SYMBOLS)) - 1).cast("long").alias("__n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__n_dup_lines"),
        F.when(F.col("__ordered").isNull(), 0).otherwise(_repeated(F.col("__windows"), F.col("__ordered"))).cast("long").alias("__n_repeat_words"),
    )


def _left_out(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("held"), doc_id), F.lit(HOLD_OUT)) == 0


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(trusted, held): ids of all documents labelled good and not toxic, and which of them are left out of the target.

    Other or null labels do not count.
    """
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("trusted")).distinct()
    return good.withColumn("held", _left_out("trusted"))


def _among(docs: DataFrame, trusted: DataFrame, held: bool) -> DataFrame:
    """The rows of `docs` whose id is among those of the written table `trusted` with this `held`; null ids never are.

    Where the ids are too many to send out, only documents that could have this `held` are shuffled: each once for both values.
    """
    some = small(trusted.filter(F.col("held") == held))
    return docs.filter(_left_out("doc_id") == held).join(some, F.col("doc_id") == F.col("trusted"), "left_semi")


def _bucket_counts(docs: DataFrame) -> list[int]:
    """N-grams of all texts in each bucket; counts are summed by bucket in each task first."""
    grams = docs.select(_words(F.col("text")).alias("words")).select(_ngrams(F.col("words")).alias("grams"))
    # explode_outer: for explode, Catalyst adds a filter that cuts each text into words once more for every word
    found = grams.select(F.explode_outer("grams").alias("k")).groupBy("k").agg(F.count("k").alias("n")).filter("k is not null").collect()
    counts = [0] * BUCKETS
    for k, n in found:
        counts[k] = n
    return counts


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """ln(target / raw) for each bucket, from (doc_id, text): raw over all documents, target over all trusted ones not left out.

    `trusted` is a written table.  Without a trusted n-gram, all ratios are 0.
    """
    target = _bucket_counts(_among(docs, trusted, held=False))
    if not sum(target):
        return [0.0] * BUCKETS
    raw = _bucket_counts(docs)
    of_raw, of_target = (math.log(sum(x) + SMOOTHING * BUCKETS) for x in (raw, target))
    return [math.log(t + SMOOTHING) - of_target - math.log(r + SMOOTHING) + of_raw for r, t in zip(raw, target)]


def score(words: Column, ratios: list[float]) -> Column:
    """Mean ratio over a text's n-grams, 0 without any; the ratios are a constant of BUCKETS numbers in the plan."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    total = F.aggregate(_ngrams(words), F.lit(0.0), lambda s, k: s + F.get(table, k))
    return F.when(F.size(words) > 0, total / (2 * F.size(words))).otherwise(0.0)


def _scored(df: DataFrame, ratios: list[float]) -> DataFrame:
    """`df` (with `__text`) with counts, `__score` and `__base_failed`."""
    out = measured(df)
    failed = (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n_words"))
    return out.withColumn("__score", score(F.col("__words"), ratios)).drop("__words").withColumn("__base_failed", failed)


def _at_place(scores: DataFrame, place: int) -> float:
    """The value at `place`, from 0 in ascending order, of the column `s` of a written table without nulls.

    Each round counts the values between two of them in BINS bins and goes on with the ends of the bin that has the place,
    until they are equal: exact, and neither a task nor the driver holds more than BINS rows.
    """
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    while low < high:
        inside = scores.filter(F.col("s").between(low, high))
        at = F.least(F.floor((F.col("s") - low) / (high - low) * BINS), F.lit(BINS - 1))
        bins = inside.groupBy(at.alias("bin")).agg(F.count("s"), F.min("s"), F.max("s")).collect()
        for _, n, low, high in sorted(bins):
            if place < n:
                break
            place -= n
    return low


def percentile(scores: DataFrame, percent: float) -> float | None:
    """The percentile of the column `s` of a written table, in proportion between two values as SQL's `percentile`; nulls do not count."""
    scores = scores.filter("s is not null")
    last = scores.count() - 1
    if last < 0:
        return None
    at = last * percent / 100
    low, high = (_at_place(scores, place) for place in (math.floor(at), math.ceil(at)))
    return low + (at - math.floor(at)) * (high - low)


def threshold(docs: DataFrame, trusted: DataFrame, ratios: list[float], lost_percent: float = LOST_PERCENT) -> float:
    """The least score to keep: a percentile over all trusted documents left out; without any, every score will do."""
    held = _among(docs, trusted, held=True)
    # no filter on what is computed: see keep_good
    passed = F.when(~F.col("__base_failed"), F.col("__score"))
    scores = written(_scored(held.select(F.col("text").alias("__text")), ratios).select(passed.alias("s")))
    found = percentile(scores, lost_percent)
    discard(scores)
    return float("-inf") if found is None else found


def _judged(df: DataFrame, docs: DataFrame, labels: DataFrame, lost_percent: float) -> DataFrame:
    """`df` (with `__text`) with counts, `__score`, `__base_failed` and `__kept`."""
    trusted = written(trusted_ids(labels))
    ratios = log_ratios(docs, trusted)
    least = threshold(docs, trusted, ratios, lost_percent)
    discard(trusted)
    return _scored(df, ratios).withColumn("__kept", ~F.col("__base_failed") & (F.col("__score") >= F.lit(least)))


def judge_documents(df: DataFrame, labels: DataFrame, lost_percent: float = LOST_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) for each row.

    The base rules count over the whole text.  score is the mean, over the text's hashed words and pairs of words, of the
    log-likelihood ratio between the multinomial of trusted documents and that of all documents.  A document is kept if
    it passes the base rules and scores no less than a threshold: of the trusted documents, one in HOLD_OUT takes no part
    in the target; the threshold is the percentile `lost_percent` of those of them that pass the base rules, so that
    about one good document in a hundred is lost.  `labels` has (doc_id, quality, toxic).

    Null text has no words and fails.  Null ids are judged like others but are never trusted; repeated rows each give a
    row and count each in the raw corpus.  Without trusted documents, scores are 0 and only the base rules decide.  An
    empty table gives none; other columns of `df` are not read.
    """
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    judged = _judged(docs.withColumnRenamed("text", "__text"), docs, labels, lost_percent)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return judged.select("doc_id", *(F.col(f"__{c}").alias(c) for c in counts))


def keep_good(df: DataFrame, labels: DataFrame, lost_percent: float = LOST_PERCENT) -> DataFrame:
    """The rows of `df` (with doc_id, text) that `judge_documents` keeps, with all their columns, whatever their names.

    Nulls, repeated rows and empty tables as there: rows without text go; those without an id are judged by their text.
    """
    docs = df.select(F.col("doc_id").cast("long"), "text")
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), F.col("text").alias("__text"))
    # a filter on what is computed would be pushed below and cut each text into words once for every use; it is not
    # pushed through a projection that numbers rows
    judged = _judged(rows, docs, labels, lost_percent).withColumn("__n", F.monotonically_increasing_id()).filter("__kept and __n >= 0")
    return judged.select(*(F.col("row")[c].alias(c) for c in df.columns))

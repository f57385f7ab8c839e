"""Sentences, vocabularies and count files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import uniform32
from .tables import written

BEGIN, END, UNKNOWN = "<s>", "</s>", "<unk>"


def marked(words: Column) -> Column:
    """Words of a sentence between its markers."""
    return F.concat(F.array(F.lit(BEGIN)), words, F.array(F.lit(END)))


def text_sentences(df: DataFrame, text_col: str = "text", lower: bool = False, multiword: str | None = None) -> DataFrame:
    """(words): a sentence for each line that has a word; null texts have none.  Words are cut at `multiword` as well, if given."""
    line = F.explode(F.split(F.lower(text_col) if lower else F.col(text_col), "\n")).alias("line")
    apart = F.replace("line", F.lit(multiword), F.lit(" ")) if multiword else F.col("line")
    return df.select(line).filter(apart.rlike(r"\S")).select(marked(F.array_remove(F.split(apart, r"\s+"), "")).alias("words"))


def vocabulary_lines(vocab: DataFrame) -> DataFrame:
    """(value): a vocabulary file, a word a line in order of ids."""
    return vocab.orderBy("wid").select(F.col("word").alias("value"))


def read_vocabulary(lines: DataFrame) -> DataFrame:
    """(word, wid) of a vocabulary or non-event file, a word a line; repeated and blank lines count once and not at all."""
    words = lines.select(F.trim("value").alias("word")).filter("word <> ''").distinct()
    return words.withColumn("wid", F.row_number().over(Window.orderBy("word")).cast("long"))


def closed(sentences: DataFrame) -> DataFrame:
    """Mapped sentences for a closed vocabulary: unknown words are taken out, not turned into a word."""
    return sentences.withColumn("words", F.array_remove("words", UNKNOWN))


def event_sentences(events: DataFrame, condition: str = "true") -> DataFrame:
    """(words): one sentence a user, its event types in order of time."""
    one = events.filter(condition).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    return one.select(marked(F.transform("e", lambda x: x["event_type"])).alias("words"))


def vocabulary(sentences: DataFrame, k: int) -> DataFrame:
    """(word, cnt, wid): the k most frequent words but the markers, with ids from 1 by count, then word."""
    counts = sentences.select(F.explode_outer("words").alias("word")).filter(~F.col("word").isin(BEGIN, END)).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    top = counts.orderBy(F.col("cnt").desc(), "word").limit(k)  # the k words bound what the window sorts
    return top.withColumn("wid", F.row_number().over(Window.orderBy(F.col("cnt").desc(), "word")).cast("long"))


#: Words of a vocabulary that may stand in a plan as constants; a larger one is joined.
PLAN_WORDS = 20_000


def map_unknown(sentences: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sentences with <unk> for words outside the vocabulary.

    A vocabulary that is counted to be small is a set in the plan, and sentences are mapped where they are.  Beyond that
    the words are joined one by one, then gathered by sentence.
    """
    if vocab.count() <= PLAN_WORDS:
        known = [BEGIN, END, *(r["word"] for r in vocab.select("word").collect())]
        return sentences.select(F.transform("words", lambda w: F.when(w.isin(known), w).otherwise(UNKNOWN)).alias("words"))
    numbered = sentences.withColumn("sid", F.monotonically_increasing_id())
    words = numbered.select("sid", F.posexplode("words").alias("at", "word")).join(vocab.select("word", "wid"), "word", "left")
    known = F.col("wid").isNotNull() | F.col("word").isin(BEGIN, END)
    mapped = words.select("sid", F.struct("at", F.when(known, F.col("word")).otherwise(UNKNOWN).alias("w")).alias("x"))
    return mapped.groupBy("sid").agg(F.sort_array(F.collect_list("x")).alias("x")).select(F.transform("x", lambda x: x["w"]).alias("words"))


def word_ids(sentences: DataFrame) -> DataFrame:
    """(word, wid) over all words with the markers; ids from 1 by count, then word.  Numbered in ranges, not in one task."""
    n = sentences.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    dealt = written(n.repartitionByRange(F.col("n").desc(), "word").sortWithinPartitions(F.col("n").desc(), "word").withColumn("mid", F.monotonically_increasing_id()))
    part = F.shiftright("mid", 33)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))  # a row a task
    return dealt.join(F.broadcast(before), part == F.col("part")).select("word", (F.col("before") + F.col("mid").bitwiseAND((1 << 33) - 1) + 1).alias("wid"))


def coded(grams: DataFrame, ids: DataFrame) -> DataFrame:
    """(ord, ctx, w0, cnt) with word ids for words: each word of an n-gram is joined by itself; n-grams with an unknown word go."""
    longest = grams.agg(F.max("ord")).first()[0] or 1
    wide = grams.select("ord", "cnt", "w0", *(F.get("ctx", F.lit(k)).alias(f"h{k}") for k in range(longest - 1)))
    for c in ("w0", *(f"h{k}" for k in range(longest - 1))):
        wide = wide.join(ids.select(F.col("word").alias(c), F.col("wid").alias(f"{c}_id")), c, "left")
    ctx = F.slice(F.array(*(F.col(f"h{k}_id") for k in range(longest - 1))), 1, F.col("ord") - 1) if longest > 1 else F.array().cast("array<bigint>")
    whole = wide.select("ord", ctx.alias("ctx"), F.col("w0_id").alias("w0"), "cnt")
    return whole.filter(F.col("w0").isNotNull() & ~F.exists("ctx", lambda x: x.isNull()))


def parted(sentences: DataFrame, seed: int, of: int = 10) -> DataFrame:
    """Sentences with `part` from 0 to of - 1, by a hash of their words: equal sentences never fall apart."""
    return sentences.withColumn("part", uniform32(seed, F.array_join("words", " ")) % of)


def read_counts(df: DataFrame) -> DataFrame:
    """Counts from lines ``w1 ... wk count`` in a column `value`; repeated n-grams add up; malformed lines are an error."""
    parts = F.split(F.trim("value"), r"\s+")
    n = F.size(parts)
    rows = df.filter(F.trim("value") != "").select((n - 1).alias("ord"), F.reverse(F.slice(parts, 1, n - 2)).alias("ctx"), F.element_at(parts, -2).alias("w0"), F.element_at(parts, -1).cast("long").alias("cnt"))
    return rows.groupBy("ord", "ctx", "w0").agg(F.sum("cnt").alias("cnt"))


def count_lines(counts: DataFrame) -> DataFrame:
    """(value): lines ``w1 ... wk count``, oldest word first."""
    return counts.select(F.concat_ws(" ", F.reverse("ctx"), "w0", F.col("cnt").cast("string")).alias("value"))

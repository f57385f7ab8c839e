"""Mixing sources to target weights: hash-threshold histograms, without sorting documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: A source's target is so many times its size at most, and no document is taken more often.
MOST_REPEATS = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: Bits of the hash that one level of histograms resolves, and levels: 36 bits tell 7e10 places apart.
BITS, LEVELS, HASH_BITS = 12, 3, 60


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place_of(key: Column) -> Column:
    """A document's place in [0, 2**60): the first 15 hex digits of an MD5; a null id is the text 'null'."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) with `target`: a row a source.

    Sources in order of code points, null last, have the WEIGHTS in turn and share the total size by weight; a target stops
    at MOST_REPEATS times the source's size, and the excess is shared anew by weight until none is above.  The
    sources that stop are the first ones by cap over weight, so that the rest share, weight by weight, one and the same
    level: the total less the caps before, over the weights left.  The windows are over sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    weighted = sources.withColumn("weight", F.get(weights, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS)))).cast("double"))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(float(MOST_REPEATS)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levelled = weighted.withColumn("level", level)
    # the level of the first source that does not stop holds for all behind it
    shared = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)
    return levelled.select("source", "source_size", F.least("cap", F.coalesce(shared["level"], F.lit(0.0)) * F.col("weight")).alias("target"))


def _cut(cells: DataFrame) -> DataFrame:
    """For each source the cell that its budget ends in: (source, cell, below): `below` words lie in the cells before.

    `cells` has (source, cell, size, budget).  A source has 2**BITS cells at most.
    """
    w = Window.partitionBy("source").orderBy("cell")
    summed = cells.withColumn("upto", F.sum("size").over(w))
    crossing = summed.filter(F.col("upto") > F.col("budget"))
    return crossing.groupBy("source").agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("size")).alias("below"), "size"), "cell").alias("x")).select("source", "x.*")


def _thresholds(docs: DataFrame) -> DataFrame:
    """What each source gives, from (source, size, place): s, source_size, target, whole, threshold."""
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sources)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = goal.withColumn("whole", F.least(whole, F.lit(MOST_REPEATS)))
    plan = plan.withColumn("budget", F.when(F.col("whole") < MOST_REPEATS, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(F.lit(0.0)))
    plan = written(plan.withColumn("cell", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")))
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - BITS * level
        here = F.shiftright("place", shift)
        inside = docs.join(plan.select(F.col("source").alias("s"), F.col("cell").alias("outer"), "budget", "below"), F.col("source").eqNullSafe(F.col("s")))
        inside = inside.filter(F.shiftright("place", shift + BITS) == F.col("outer"))
        cells = inside.groupBy("source", here.alias("cell"), "budget", "below").agg(F.sum("size").alias("size"))
        cut = _cut(cells.select("source", "cell", "size", (F.col("budget") - F.col("below")).alias("budget")))
        found = cut.select(F.col("source").alias("s"), F.col("cell").alias("c"), F.col("below").alias("b"), F.col("size").alias("n"))
        joined = plan.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
        # a budget that is not passed takes all of the outer cell: its threshold is the next one
        nxt = F.coalesce(F.col("c"), F.shiftleft(F.col("cell") + 1, BITS))
        below = F.col("below") + F.coalesce(F.col("b"), F.lit(0))
        plan = joined.select("source", "source_size", "target", "whole", "budget", nxt.alias("cell"), below.alias("below"), F.coalesce("n", F.lit(0)).alias("n"))
        plan = written(plan if level == LEVELS else plan.drop("n"))
    nearer = F.when((F.col("n") > 0) & (F.col("below") + F.col("n") - F.col("budget") < F.col("budget") - F.col("below")), F.col("cell") + 1).otherwise(F.col("cell"))
    return plan.select(F.col("source").alias("s"), "source_size", "target", "whole", nearer.alias("threshold"))


def _measured(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return written(
        df.select(
            df[id_col].cast("long").alias("doc_id"), df[source_col].alias("source"), n_words(df[text_col]).alias("size"), place_of(df[id_col]).alias("place")
        )
    )


def _copies() -> Column:
    """How often a document with a `place` is taken, beside what `_thresholds` gives for its source."""
    return F.col("whole") + (F.shiftright("place", HASH_BITS - BITS * LEVELS) < F.col("threshold")).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How much of each document a mix of all sources takes: (doc_id, size, source_size, target, taken) for each row.

    A source is taken whole as often as its target allows; the rest of the target, its budget, is a threshold on the
    documents' hashed ids: those below are taken once more, so a larger budget takes a superset.  The threshold comes from
    sizes summed by source and hash cell: the cell where the running sum passes the budget is resolved by the next bits,
    level by level; at the last, the nearer side is taken.  Documents are never sorted, and what is summed by source and
    cell is pre-aggregated, so a source of any share costs 2**BITS rows for each task.

    Null text has size 0.  Null sources are one source, the last.  Repeated ids (and all null ids) have one place and
    go together.  A source without words takes none.  The same rows give the same mix.  An empty table gives none; other
    columns of `df` are not read.
    """
    docs = _measured(df, id_col, text_col, source_col)
    joined = docs.join(_thresholds(docs), F.col("source").eqNullSafe(F.col("s")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mixed_documents(df: DataFrame) -> DataFrame:
    """The mix itself: each row of `df` (with doc_id, text, source) as often as `mix` takes it, with all its columns, whatever their names.

    Null and empty texts are taken as their places fall, and add nothing.  Null sources, repeated ids and null ids as in
    `mix`; an empty table gives none.
    """
    plan = _thresholds(_measured(df, "doc_id", "text", "source"))
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), place_of(F.col("doc_id")).alias("place"))
    copies = rows.join(plan, F.col("row")["source"].eqNullSafe(F.col("s"))).withColumn("copies", _copies()).filter("copies > 0")
    again = copies.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return again.select(*(F.col("row")[c].alias(c) for c in df.columns))

"""Removal of later copies of runs of units (lines or sentences) that stand somewhere else before.

Both operators go the same way: hash every run in every document, find for each hash the first document that has it, join
that back to the runs of the others, and merge the places of these by document.

A document is (doc_id, text_hash): ids ascend, null last; rows of one id follow each other by the hash of their text; rows
alike in both are one document, and all of them keep what is first there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import small, written

#: Gives for a text its units, as (start, end) in characters, and its runs, as (hash of 16 bytes, first unit, last unit).
Cut = Callable[[str], tuple[list[tuple[int, int]], list[tuple[bytes, int, int]]]]

RUNS = "doc_id long, text_hash long, h1 long, h2 int, start int, stop int"
#: The most frequent runs, so many: each may be in any share of all documents, so they are sent out and their rows spread.
HOT_RUNS = 10_000


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of characters, ascending; those that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _placed(text: str, cut: Cut) -> tuple[list[bytes], list[tuple[int, int]], list[tuple[int, int]]]:
    """Hashes of 12 bytes of a text's distinct runs, their first places, and what later ones of the same text cover.

    A place goes from the characters of the run's first unit up to the unit behind its last.
    """
    units, runs = cut(text)
    starts = [a for a, _ in units] + [len(text)]
    first: dict[bytes, tuple[int, int]] = {}
    later = []
    for h, a, b in runs:
        place = (starts[a], starts[b + 1])
        if first.setdefault(h[:12], place) != place:
            later.append(place)
    return list(first), list(first.values()), _merged(later)


def runs_of(docs: DataFrame, cut: Cut) -> DataFrame:
    """RUNS of (doc_id, text_hash, text): each run of a document once; what its repetitions cover has no hash (null)."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "text_hash", "h1")] + [(c, pa.int32()) for c in ("h2", "start", "stop")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, places, hashed, rows = [], [], [], []
            for text in batch.column(2):
                own, at, later = _placed(text.as_py() or "", cut)
                hashes += own
                places += at + later
                hashed += [True] * len(own) + [False] * len(later)
                rows.append(len(at) + len(later))
            keys = [batch.column(k).take(pa.array(np.repeat(np.arange(len(rows)), rows))) for k in (0, 1)]
            halves = np.zeros(len(hashed), [("h1", ">i8"), ("h2", ">i4")])
            halves[np.array(hashed, bool)] = np.frombuffer(b"".join(hashes), halves.dtype)
            start, stop = np.array(places, "i4").reshape(-1, 2).T
            none = ~np.array(hashed, bool)
            yield pa.RecordBatch.from_arrays([*keys, pa.array(halves["h1"].astype("i8"), mask=none), pa.array(halves["h2"].astype("i4"), mask=none), pa.array(start), pa.array(stop)], schema=schema)

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, RUNS)


def later_places(runs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans): for each document the places of runs that stand before, there or in other documents.

    Of each hash only the least document and the count are kept, by partial aggregation, so a run that all documents
    share is one row for each task.  They are joined back to the runs, whose rows are not brought together for it: those
    of hot runs are dealt by document.  The spans of a document are no more than its own runs.
    """
    document = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    shared = written(runs.filter("h1 is not null").groupBy("h1", "h2").agg(F.min(document).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    hot = F.broadcast(written(shared.orderBy(F.col("n").desc(), "h1", "h2").limit(HOT_RUNS)))
    rare = shared.join(hot, ["h1", "h2"], "left_anti").select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("least").alias("rare"))
    known = runs.join(hot.select("h1", "h2", F.col("least").alias("hot")), ["h1", "h2"], "left")
    settled = F.col("h1").isNull() | F.col("hot").isNotNull()
    dealt = known.withColumn("k1", F.when(settled, F.xxhash64("doc_id", "text_hash", "start")).otherwise(F.col("h1")))
    found = dealt.join(rare, (F.col("k1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & ~settled, "left")
    later = found.filter(F.col("h1").isNull() | ~document.eqNullSafe(F.coalesce("hot", "rare", document)))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters of any of the spans.  Where the end goes, so does the one white space before it."""
    out, at = [], 0
    for start, stop in _merged(spans):
        out.append(text[at:start])
        at = stop
    left = "".join([*out, text[at:]])
    return left[:-1] if spans and at == len(text) and left[-1:].isspace() else left


def _left(text: Column, spans: Column) -> Column:
    """What `without` gives; rows without spans stay as they are."""

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([without(t.as_py(), [(x["start"], x["stop"]) for x in s.as_py()]) if s.is_valid else t.as_py() for t, s in zip(texts, spans)], pa.string())

    return F.arrow_udf(run, "string")(text, spans)


def _cut_later(rows: DataFrame, key: tuple[Column, Column, Column], cut: Cut) -> DataFrame:
    """`rows` with `_left`, the text that is left of each; `key`: doc_id, hash of the text, text.

    Where the marked documents are counted to be few, only their texts are shuffled; else all.
    """
    doc_id, text_hash, text = key
    docs = rows.select(doc_id.alias("doc_id"), text_hash.alias("text_hash"), text.alias("text"))
    marks = written(later_places(runs_of(docs, cut))).toDF("_id", "_hash", "_spans")
    same = doc_id.eqNullSafe(F.col("_id")) & (text_hash == F.col("_hash"))
    keys = marks.select("_id", "_hash")
    if small(keys) is keys:
        return rows.join(marks, same, "left").withColumn("_left", _left(text, F.col("_spans"))).drop(*marks.columns)
    keys = F.broadcast(keys)
    marked = rows.join(keys, same, "left_semi").join(marks, same).withColumn("_left", _left(text, F.col("_spans"))).drop(*marks.columns)
    return marked.unionByName(rows.join(keys, same, "left_anti").withColumn("_left", text))


def remove_later(df: DataFrame, cut: Cut, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_removed) for every row of `df`: the text that is left, the characters that went."""
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    done = _cut_later(docs, (F.col("doc_id"), F.xxhash64("text"), F.col("text")), cut)
    n = F.coalesce(F.char_length("text") - F.char_length("_left"), F.lit(0)).cast("long")
    return done.select("doc_id", F.col("_left").alias("text"), n.alias("n_removed"))


def remove_in_place(df: DataFrame, cut: Cut, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with its texts cut as in `remove_later`; all other columns stay as they are, whatever their names."""
    row = F.col("row")
    text = row[text_col]
    done = _cut_later(df.select(F.struct(*(df[c] for c in df.columns)).alias("row")), (row[id_col].cast("long"), F.xxhash64(text), text), cut)
    return done.select(*((F.col("_left") if c == text_col else row[c]).alias(c) for c in df.columns))

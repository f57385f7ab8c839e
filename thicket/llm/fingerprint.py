"""Document fingerprints: quartile bucket digests over hashed byte triplets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 128
#: Difference at which two digests are as unlike as two of unrelated content: per bucket, the mean of |a - b| for
#: independent codes from 0 to 3.  Likeness is 0 from there on.
MOST = 1.25 * BUCKETS
#: Weight of a step in length (a factor of 1.1) and of a step in a quartile ratio.
LENGTH_WEIGHT, RATIO_WEIGHT = 1.0, 2.0

_TRIPLETS = 1 << 15
# A fixed shuffle of the hashed triplets over the buckets.
_TO_BUCKET = np.random.RandomState(7).permutation(_TRIPLETS) % BUCKETS

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Ranges of doc_id for each shuffle partition, so that a partition gets several.
RANGES_PER_PARTITION = 4
#: Sampled ids for each range, from which its bounds are taken.
SAMPLES_PER_RANGE = 20


def digest(data: bytes) -> bytes:
    """Length step, two quartile ratios, then two bits a bucket: in which quarter of all buckets its count lies.

    Every triplet of consecutive bytes counts.  Data of fewer than three bytes has all codes 0.
    """
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    t = (b[:-2] * 0x9E3779B1 + b[1:-1] * 0x85EBCA6B + b[2:] * 0xC2B2AE35) if len(b) > 2 else np.zeros(0, np.uint32)
    counts = np.bincount(_TO_BUCKET[((t ^ (t >> 13)) * np.uint32(0x27D4EB2F)) >> 17], minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, round(math.log(len(data), 1.1))) if data else 0
    ratios = [int(16 * q // q3) if q3 else 0 for q in (q1, q2)]
    packed = codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]
    return bytes([length, *ratios]) + packed.astype(np.uint8).tobytes()


def _codes(d: bytes) -> np.ndarray:
    b = np.frombuffer(d, np.uint8)[3:]
    return np.stack([b >> 6, b >> 4 & 3, b >> 2 & 3, b & 3]).astype(np.int16)


def difference(a: bytes, b: bytes) -> float:
    """Score of two digests: 0 for equal ones, MOST at the highest."""
    far = LENGTH_WEIGHT * max(0, abs(a[0] - b[0]) - 1) + RATIO_WEIGHT * sum(max(0, abs(a[i] - b[i]) - 1) for i in (1, 2))
    return min(MOST, far + float(np.abs(_codes(a) - _codes(b)).sum()))


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests, 0 for those of unrelated content."""
    return 1 - difference(a, b) / MOST


def _bounds(docs: DataFrame, n_ranges: int) -> tuple[np.ndarray, int]:
    """Sorted ids that cut (doc_id, ...) into `n_ranges` ranges of like numbers of rows, about, and the ranges for null ids.

    They come from a sample of SAMPLES_PER_RANGE ids a range.  An id that many rows share comes as often as it fills ranges.
    The bounds say where rows are worked on, not what is worked out.
    """
    n = docs.count()
    some = docs.select("doc_id").sample(min(1.0, SAMPLES_PER_RANGE * n_ranges / max(n, 1)), 3).toArrow().column(0)
    ids = np.sort(some.drop_null().to_numpy())
    nulls = math.ceil(n_ranges * some.null_count / max(len(some), 1))
    return ids[np.linspace(0, len(ids), n_ranges + 1)[1:-1].astype(int)] if len(ids) else ids, max(1, nulls)


def _range(bounds: np.ndarray, nulls: int) -> Callable[[Column, Column], Column]:
    """The range of (doc_id, text_hash): ranges ascend in both, null ids last; rows of one id that fills several are dealt by hash."""

    def run(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        own = ids.fill_null(0).to_numpy()
        first, behind = np.searchsorted(bounds, own, "left"), np.searchsorted(bounds, own, "right")
        start, width = np.where(missing, len(bounds) + 1, first), np.where(missing, nulls, behind - first)
        step = (hashes.to_numpy().astype(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        return pa.array((start + (width.astype(np.uint64) * step >> np.uint64(32)).astype(np.int64)).astype("i4"))

    return F.arrow_udf(run, "int")


def ranged(docs: DataFrame, n_ranges: int) -> DataFrame:
    """Rows (doc_id, text_hash, text) with `range`, ascending, and behind each range its successor as `ghost` rows.

    The successor of a range is the first row of the next range that has rows, of the last range that of the first: a row
    a range is sent twice, whatever the number of documents.  The driver holds a few numbers for each range.
    """
    spark = docs.sparkSession
    dealt = docs.withColumn("range", _range(*_bounds(docs, n_ranges))("doc_id", "text_hash"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash"))
    heads = sorted((r["range"], r["head"]["doc_id"], r["head"]["text_hash"]) for r in dealt.groupBy("range").agg(least.alias("head")).collect())
    follows = spark.createDataFrame([(i, h, heads[k - 1][0]) for k, (_, i, h) in enumerate(heads)], "head long, head_hash long, to int")
    at_head = docs.join(F.broadcast(follows), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("text_hash") == F.col("head_hash")))
    one = at_head.groupBy("to", "doc_id", "text_hash").agg(F.min("text").alias("text"))  # rows alike in both
    ghosts = one.select("doc_id", "text_hash", "text", F.col("to").alias("range"), F.lit(True).alias("ghost"))
    return dealt.select("doc_id", "text_hash", "text", "range", F.lit(False).alias("ghost")).unionByName(ghosts)


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness; RESULT for each row of `df`.

    Edited: the last floor(n_chars / 2) code points give way to the first as many (or all) of the next document in
    ascending doc_id, of the first one behind the last.  Documents are dealt by ranges of doc_id and text hash, sorted
    within a range and read once; each range also gets its successor.  edited_sha256 is of the edited text in UTF-8; near_edited and
    near_next are the likeness of the text to the edited text and to the next document.

    Null text: empty.  Null ids come last.  Rows of one doc_id, and those without one, follow each other by the hash of their
    text, and equal rows in any order, so that the result is the same in every run; many such rows fill several ranges.
    A single row follows itself; an empty table gives none.
    Other columns of `df` are not read.
    """
    docs = df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(df[text_col]).alias("text_hash"), df[text_col].alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def row(doc_id: int | None, text: str, own: bytes, after: str, after_digest: bytes) -> tuple:
        half = len(text) // 2
        edited = (text[: len(text) - half] + after[:half]).encode()
        other = digest(edited)
        return doc_id, len(text), hashlib.sha256(edited).hexdigest(), own.hex(), other.hex(), likeness(own, other), likeness(own, after_digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for the one behind it
        for batch in batches:
            rows = []
            for doc_id, text, at, ghost in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if ghost and held is None:
                    continue  # the range has its successor
                text = text.as_py() or ""
                own = digest(text.encode())
                if held is not None:
                    rows.append(row(*held, text, own))
                held = None if ghost else (doc_id, text, own)
            columns = zip(*rows) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    dealt = ranged(docs, RANGES_PER_PARTITION * n).repartition(n, "range")
    return dealt.sortWithinPartitions("range", "ghost", F.col("doc_id").asc_nulls_last(), "text_hash", "text").select("doc_id", "text", "range", "ghost").mapInArrow(run, RESULT)

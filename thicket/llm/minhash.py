"""Near-duplicate documents: universal hash minima, bands, signature check, exact check, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import small, written

#: Hash functions, in bands of so many rows.  At similarity 0.8, all 32 bands miss with probability (1 - 0.8**4)**32 = 5e-8.
HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
#: Fewer equal minima than this share rule a pair out before the exact check.  At similarity 0.8 the share has mean 0.8 and
#: deviation 0.035: 0.6 is more than five deviations below.
SIGNATURE_FLOOR = 0.6
#: Members of one bucket whose signatures (512 bytes each) one task compares with each other at most.
BLOCK = 4000
#: Members and bytes of one group whose full sets one task compares with each other, about; past either the group is cut into blocks.
SET_BLOCK, SET_BYTES = 1000, 16 << 20

# A-Z to lower case; white space [\x20\x09-\x0D] is what bytes.split() cuts at.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RANDOM = np.random.RandomState(11)
_A = (_RANDOM.randint(0, 1 << 62, HASHES, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RANDOM.randint(0, 1 << 62, HASHES, dtype=np.int64).astype(np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_CHUNK = 512

SIGNED = "doc_id long, text_hash long, n_shingles long, set_key binary, signature binary"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER).split()


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of `size` words, as sorted 64-bit hashes; a shorter text is one shingle, none has none."""
    words = words_of(text or "")
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    width = min(size, len(h))
    out = np.full(n, width, np.uint64)
    for k in range(width):  # order within the shingle counts: each step mixes what came before
        out = (out ^ h[k : k + n]) * _MIX[k % len(_MIX)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray) -> bytes:
    """The minimum of each multiply-add hash over the shingles, its upper 32 bits, as bytes."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _CHUNK):
        np.minimum(least, (_A[:, None] * shingles[None, i : i + _CHUNK] + _B[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(">u4").tobytes()


def signed(docs: DataFrame, size: int) -> DataFrame:
    """SIGNED for each row of (doc_id, text): set_key is a 128-bit hash of the shingle set, null for an empty one."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, signatures = [], [], []
            for text in batch.column(2):
                s = shingle_hashes(text.as_py(), size)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], schema=schema
            )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, SIGNED)


def _classes(rows: DataFrame) -> DataFrame:
    """A row for each distinct shingle set: node, set_key, holder (doc_id and text_hash of its smallest row), signature."""
    by_key = rows.filter("set_key is not null").groupBy("set_key")
    one = by_key.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("h"), F.first("signature").alias("signature"))
    return written(
        one.select(F.monotonically_increasing_id().alias("node"), "set_key", F.col("h.doc_id").alias("doc_id"), F.col("h.text_hash").alias("text_hash"), "signature")
    )


def _banded(classes: DataFrame) -> DataFrame:
    """(node, band, bucket): BANDS rows for each class; a bucket is the hash of a band's number and its minima."""
    width = 4 * ROWS
    buckets = F.array(*(F.xxhash64(F.lit(i), F.substring("signature", i * width + 1, width)) for i in range(BANDS)))
    return classes.select("node", F.posexplode(buckets).alias("band", "bucket"))


def _sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, set) for the classes in `nodes`, cut anew from the text of the row that holds each, in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for node, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                packed = shingle_hashes(text.as_py(), size).tobytes()
                if xxhash.xxh3_128_digest(packed) == key:  # else another text has the same text_hash
                    nodes.append(node)
                    sets.append(packed)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])

    wanted = written(classes.join(nodes, "node", "left_semi").select("node", "set_key", F.col("doc_id").alias("held_by"), "text_hash"))
    texts = docs.withColumn("text_hash", F.xxhash64("text")).join(small(wanted), "text_hash").filter(F.col("doc_id").eqNullSafe(F.col("held_by")))
    # repeated rows: one text for each, before anything is shuffled
    one = texts.groupBy("node", "set_key", F.xxhash64(F.lit(1), "text").alias("more")).agg(F.first("text").alias("text"))
    return written(one.select("node", "set_key", "text").mapInArrow(run, "node long, set binary").dropDuplicates(["node"]))


def _checked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets meet the similarity: first by signature, then on the full sets."""
    sig = classes.select("node", "signature")

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = zip(a.to_pylist(), b.to_pylist())
        return pa.array([bool(np.count_nonzero(np.frombuffer(x, ">u4") == np.frombuffer(y, ">u4")) >= SIGNATURE_FLOOR * HASHES) for x, y in pairs], pa.bool_())

    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):  # one pair of sets at a time: they can be long
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    likely = written(pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").filter(alike("sa", "sb")).select("a", "b"))
    nodes = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(nodes, classes, docs, size)
    return likely.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b").filter(linked("xa", "xb")).select("a", "b")


def _hub_pairs(banded: DataFrame) -> DataFrame:
    """Each class with the smallest class of each of its buckets: a link for each member, no pairs of members."""
    hubs = banded.groupBy("bucket").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", "b")
    return banded.join(hubs, "bucket").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _forest(label: np.ndarray, may: Callable[[int, np.ndarray], np.ndarray], test: Callable[[int, np.ndarray], Iterator[int]]) -> list[tuple[int, int]]:
    """Links of places that `test` finds, less those that join what is joined already: fewer than there are places.

    `label` says what is joined from the start; it is changed.  may(x, ys) is a mask of the places to test x against;
    test(x, ys) gives those of ys that are linked to x.
    """
    found = []
    for x in range(len(label) - 1):
        ys = x + 1 + np.nonzero(label[x + 1 :] != label[x])[0]
        ys = ys[may(x, ys)]
        for y in test(x, ys) if len(ys) else ():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                found.append((x, int(y)))
    return found


def _alike(sig: np.ndarray, x: int, ys: np.ndarray) -> np.ndarray:
    """Those of the places ys whose signatures do not rule them out as partners of x."""
    return ys[np.count_nonzero(sig[ys] == sig[x], axis=1) >= SIGNATURE_FLOOR * HASHES]


def _linked(ids: list[np.ndarray], flags: np.ndarray, label: np.ndarray, percent: int, x: int, ys: np.ndarray) -> Iterator[int]:
    """Those of the places ys whose full sets meet the similarity; what `label` has joined meanwhile is passed over."""
    flags[ids[x]] = True
    n = len(ids[x])
    for y in ys:
        m = len(ids[y])
        if label[y] != label[x] and 100 * min(n, m) >= percent * max(n, m):
            both = np.count_nonzero(flags[ids[y]])
            if 100 * both >= percent * (n + m - both):
                yield y
    flags[ids[x]] = False


def _numbered(sets: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each set as numbers of the shingles that occur in any of them, and a flag for each such shingle, all False."""
    arrays = [np.frombuffer(s, np.uint64) for s in sets]
    every, numbers = np.unique(np.concatenate(arrays), return_inverse=True)
    return np.split(numbers, np.cumsum([len(a) for a in arrays])[:-1]), np.zeros(len(every), bool)


def _in_blocks(members: DataFrame, key: str, k: Column) -> DataFrame:
    """`members`, with columns i <= j and own: each row once for each pair of blocks that its own block is in."""
    cut = members.withColumn("k", k.cast("long")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return dealt.select(F.col(key).alias("key"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")


def _joined_up(dealt: DataFrame, compare: Callable[[np.ndarray, list[list[bytes]]], list[tuple[int, int]]]) -> DataFrame:
    """Distinct links (a, b) that `compare` finds within each (key, i, j) of `dealt`: six longs, then binary columns."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: np.ndarray, wide: list[list[bytes]]) -> list[tuple[int, int]]:
            node = rows[:, 4]
            return [(max(node[x], node[y]), min(node[x], node[y])) for x, y in compare(rows, wide)] if len(rows) > 1 else []

        rows, wide = np.zeros((0, 6), np.int64), []
        for batch in batches:
            rows = np.concatenate([rows, np.stack([c.to_numpy() for c in batch.columns[:6]], axis=1)])
            new = [c.to_pylist() for c in batch.columns[6:]]
            wide = [w + n for w, n in zip(wide, new)] if wide else new
            starts = [0, *(1 + np.nonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))[0])] if len(rows) else [0]
            found = [p for s, e in zip(starts, starts[1:]) for p in links(rows[s:e], [w[s:e] for w in wide])]
            rows, wide = rows[starts[-1] :], [w[starts[-1] :] for w in wide]  # the last group may go on in the next batch
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], schema=schema)
        found = links(rows, wide)
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], schema=schema)

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _apart(rows: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """Places that may be compared: in other components, and in other blocks where the group is of two blocks."""
    _, i, j, own, _, root = rows.T
    across = i[0] != j[0]  # pairs within a block belong to the block's own group
    return lambda x, ys: (root[ys] != root[x]) & (own[ys] != own[x]) if across else root[ys] != root[x]


def _gathered(banded: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, group): classes that may still be linked to a class of another component share a group.

    Only buckets that still hold two components count.  Each is compared by signatures in pairs of blocks; each pair of
    blocks gives a forest over its likely links, fewer than it has members, and groups are the components of these.
    """
    rooted = banded.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    still_open = rooted.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("n")).filter("r1 <> r2")
    dealt = _in_blocks(rooted.join(still_open.select("bucket", "n"), "bucket"), "bucket", F.ceil(F.col("n") / BLOCK))

    def compare(rows: np.ndarray, wide: list[list[bytes]]) -> list[tuple[int, int]]:
        sig = np.frombuffer(b"".join(wide[0]), np.uint32).reshape(-1, HASHES)
        return _forest(np.arange(len(rows)), _apart(rows), lambda x, ys: _alike(sig, x, ys))

    likely = _joined_up(dealt.join(classes.select("node", "signature"), "node").select("key", "i", "j", "own", "node", "root", "signature"), compare)
    return connected_components(likely.toDF("u", "v")).withColumnRenamed("root", "group")


def _links_across(groups: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components: the full sets of each group are compared in pairs of blocks of bounded size.

    Every pair of a group meets in one task, and is checked there unless that task has joined the two already; so each
    task gives a forest of links, fewer than it has members, and no pair is written before it is known to be a link.
    """
    sets = _sets(groups.select("node"), classes, docs, size)
    narrow = written(groups.join(sets.select("node", F.length("set").alias("bytes")), "node"))
    cut = narrow.groupBy("group").agg(F.ceil(F.greatest(F.count(F.lit(1)) / SET_BLOCK, F.sum("bytes") / SET_BYTES)).alias("blocks"))
    rooted = narrow.join(cut, "group").join(roots, "node", "left").select("group", "node", "blocks", F.coalesce("root", "node").alias("root"))
    dealt = _in_blocks(rooted, "group", F.greatest("blocks", F.lit(1)))

    def compare(rows: np.ndarray, wide: list[list[bytes]]) -> list[tuple[int, int]]:
        sig = np.frombuffer(b"".join(wide[0]), np.uint32).reshape(-1, HASHES)
        ids, flags = _numbered(wide[1])
        label = np.unique(rows[:, 5], return_inverse=True)[1]
        return _forest(label, _apart(rows), lambda x, ys: _linked(ids, flags, label, percent, x, _alike(sig, x, ys)))

    full = dealt.join(classes.select("node", "signature"), "node").join(sets, "node")
    return _joined_up(full.select("key", "i", "j", "own", "node", "root", "signature", "set"), compare)


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `df`.

    A document's set: its distinct shingles of `size` words; documents are linked where 100 * intersection >= percent *
    union.  1. One pass signs each text.  Texts with equal sets form a class; only classes are compared from here on, so
    copies are never paired.  2. Classes meet in band buckets.  Each is checked against the smallest class of its
    buckets, by signature and then on the full sets, and links give components.  3. Where members of a bucket then still
    lie in several components, those that may be linked are gathered in groups, each class once; the groups' full sets are
    compared in blocks for links that the hubs left out, and components are joined anew.
    component_id is the smallest doc_id reachable; kept says whether it is the row's own.

    Null, empty and blank texts have an empty set and are linked with nothing: each is its own component.  Rows with a
    null id are members like others but give the component's id only where no member has one: it is null then, and these
    rows are kept.  Repeated rows are one class; those with the smallest id are all kept.  An empty table gives none; other
    columns of `df` are not read.
    """
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    rows, component = _components(docs, size, percent)
    return rows.join(component, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("set_key").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )


def _components(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """SIGNED without signatures, and (set_key, component_id) for every class."""
    rows = written(signed(docs, size))
    classes = _classes(rows)
    banded = written(_banded(classes))
    links = written(_checked(_hub_pairs(banded), classes, docs, size, percent))
    roots = connected_components(links.toDF("u", "v"))
    groups = written(_gathered(banded, roots, classes))
    if not groups.isEmpty():
        links = links.unionByName(_links_across(groups, roots, classes, docs, size, percent))
        roots = connected_components(links.toDF("u", "v"))
    rooted = written(classes.select("node", "set_key", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.select("doc_id", "text_hash", "n_shingles", "set_key"), written(rooted.join(smallest, "root").select("set_key", "component_id"))


def keep_one_of_each(df: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `df` (with doc_id, text) that `near_duplicates` keeps, with all their columns.

    Nulls and ties as there, but of repeated rows that share the smallest id and the shingle set, all stay.
    """
    docs = df.select(F.col("doc_id").cast("long"), "text")
    rows, component = _components(docs, size, percent)
    # a row goes if its set belongs to a component with a smaller id; rows of one id may have several texts
    leaves = rows.join(component, "set_key").filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = leaves.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct()
    whole = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"))  # names of further columns cannot clash
    same = F.col("row")["doc_id"].cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64(F.col("row")["text"]) == F.col("gone_text"))
    return whole.join(gone, same, "left_anti").select(*(F.col("row")[c].alias(c) for c in df.columns))

"""Splitting of tree nodes: candidate sets, their score, and the exchange search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import uniform32, xlogx

#: Moves that gain less are not made: else rounding could move a word to and fro.
LEAST_MOVE = 1e-5
MODES = ("both", "random-select", "random-init", "none")
ATTEMPTS = 64


def elements(rows: DataFrame, positions: Iterable[int]) -> DataFrame:
    """(tree_id, path, pos, elem, w0, cnt): for the history word at each position, what follows it."""
    pos = F.explode(F.array(*map(F.lit, positions))).alias("pos")
    long = rows.select("tree_id", "path", "ctx", "w0", "cnt", pos).withColumn("elem", F.get("ctx", F.col("pos")))
    return long.groupBy("tree_id", "path", "pos", "elem", "w0").agg(F.sum("cnt").alias("cnt"))


def element_stats(elems: DataFrame) -> DataFrame:
    c = F.col("cnt")
    return elems.groupBy("tree_id", "path", "pos", "elem").agg(F.sum("cnt").alias("total"), F.count_if(c > 0).alias("types"), F.count_if(c >= 2).alias("min2"), F.count_if(c >= 3).alias("min3"))


def split_gain(elems: DataFrame, side: Column) -> DataFrame:
    """(tree_id, path, pos, gain) of splitting at `side` (0 or 1, from elem): the rise in log-likelihood, natural log."""
    node = ["tree_id", "path", "pos"]
    by_word = elems.groupBy(*node, side.alias("side"), "w0").agg(F.sum("cnt").alias("c"))
    by_side = by_word.groupBy(*node, "side").agg(F.sum(xlogx(F.col("c"))).alias("s"), F.sum("c").alias("c"))
    split = by_side.groupBy(*node).agg(F.sum(F.col("s") - xlogx(F.col("c"))).alias("split"))
    whole = elems.groupBy(*node, "w0").agg(F.sum("cnt").alias("c")).groupBy(*node).agg((F.sum(xlogx(F.col("c"))) - xlogx(F.sum("c"))).alias("whole"))
    return split.join(whole, node).select(*node, (F.col("split") - F.col("whole")).alias("gain"))


def position_kept(seed: int, alpha: float) -> Column:
    """Whether a position is drawn, from columns tree_id, path, pos, attempt: a coin of weight alpha."""
    return uniform32(seed, F.col("tree_id"), F.col("path"), F.col("pos"), F.col("attempt")) < F.lit(int(alpha * 2**32))


def _uniform32(*parts: object) -> int:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def initial_side(seed: int, tree: int, path: str, pos: int, elems: list[int], mode: str) -> dict[int, int]:
    """Side of each element: by parity of its id, or by a fair coin, drawn anew until both sides have one."""
    if mode in ("none", "random-select"):
        return {e: e % 2 for e in elems}
    for attempt in range(ATTEMPTS):
        side = {e: _uniform32(seed, tree, path, pos, e, attempt) & 1 for e in elems}
        if len(set(side.values())) == 2:
            return side
    return {e: e % 2 for e in elems}


def _xl(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(elem: np.ndarray, word: np.ndarray, cnt: np.ndarray, side: dict[int, int]) -> tuple[dict[int, int], float]:
    """Best sides that single moves reach, and the gain over no split, from (element, word, count), each pair once.

    Sweeps go from one side to the other and back, over ids ascending, until neither moves anything; a move counts at once.
    Counts of a side are one array over the words; a move looks at the moved element's words alone.
    """
    by = np.argsort(elem, kind="stable")
    ids, starts = np.unique(elem[by], return_index=True)
    words, w = np.unique(word[by], return_inverse=True)
    c = cnt[by].astype(np.int64)
    cut = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(c)])]
    size = np.add.reduceat(c, starts)
    at = np.array([side[int(e)] for e in ids])
    held = np.zeros((2, len(words)), np.int64)
    np.add.at(held, (np.repeat(at, [s.stop - s.start for s in cut]), w), c)
    sums = held.sum(axis=1)
    moved = True
    while moved:
        moved = False
        for source in (0, 1):
            f, t = held[source], held[1 - source]
            for k in np.nonzero(at == source)[0]:
                own, n, y = w[cut[k]], c[cut[k]], size[k]
                fo, to = f[own], t[own]
                delta = float((_xl(fo - n) - _xl(fo) + _xl(to + n) - _xl(to)).sum())
                before, after = np.array([sums[source], sums[1 - source]]), np.array([sums[source] - y, sums[1 - source] + y])
                if delta + float((_xl(before) - _xl(after)).sum()) > LEAST_MOVE:
                    f[own] -= n
                    t[own] += n
                    sums += np.where(np.arange(2) == source, -y, y)
                    at[k], moved = 1 - source, True
    whole = held.sum(axis=0)
    gain = float(_xl(held).sum() - _xl(sums).sum() - _xl(whole).sum() + _xl(whole.sum()))
    return dict(zip(ids.tolist(), at.tolist())), gain


def search(elems: DataFrame, seed: int, mode: str) -> DataFrame:
    """(tree_id, path, pos, elem, side, gain): the exchange search for each node and position.

    A group holds the distinct (elem, w0) pairs of one node and position, which the squared vocabulary bounds, not the corpus.
    """

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tree, path, pos = key
        ids = sorted(map(int, group["elem"].unique()))
        side, gain = {}, 0.0
        if len(ids) > 1:
            side, gain = exchange(*(group[c].to_numpy() for c in ("elem", "w0", "cnt")), initial_side(seed, tree, path, pos, ids, mode))
        n = len(side)
        ints = {"tree_id": np.full(n, tree), "pos": np.full(n, pos), "elem": np.array(list(side), "int64"), "side": np.array(list(side.values()), "int64")}
        return pd.DataFrame(ints | {"path": pd.Series([path] * n, dtype=object), "gain": np.full(n, gain)})[["tree_id", "path", "pos", "elem", "side", "gain"]]

    return elems.groupBy("tree_id", "path", "pos").applyInPandas(run, "tree_id int, path string, pos int, elem long, side int, gain double")

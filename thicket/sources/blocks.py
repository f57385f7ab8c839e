r"""Trees in blocks: files too large for one pre-order text, cut at every so many levels.

A block stands between ``\begin\`` and ``\end\``.  It opens with ``subtree id logl heldout`` (ids are negative) and its
question line, or is ``subtree id = leaf number logl heldout``; its nodes follow in pre-order, each a line of its kind with
logl and heldout and a question line.  An inner node at the cut is a line ``subtree id logl heldout`` alone: its question is in
its own block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "\\begin\\", "\\end\\"


def block_lines(edges: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """(tree_id, block, path, value): the text of blocks of `levels` levels, in order of (tree_id, block, path).

    From EDGES and (tree_id, path, is_leaf, logl, heldout_sum).  Only the roots of blocks are numbered in one task a tree.
    """
    lead = edges.groupBy("tree_id", F.col("child").alias("path")).agg(F.first("pos").alias("pos"), F.sort_array(F.collect_set("word")).alias("words"))
    leaf_no = F.row_number().over(Window.partitionBy("tree_id").orderBy("path"))
    leaves = nodes.filter("is_leaf").select("tree_id", "path", leaf_no.alias("leaf_id"))
    at_cut = (F.length("path") % levels == 0) & (~F.col("is_leaf") | (F.col("path") == ""))
    number = -F.row_number().over(Window.partitionBy("tree_id").orderBy(F.length("path"), "path"))
    roots = nodes.filter(at_cut).select("tree_id", "path", number.alias("block_id"))
    full = nodes.join(lead, ["tree_id", "path"], "left").join(leaves, ["tree_id", "path"], "left").join(roots, ["tree_id", "path"], "left")
    question = F.concat_ws(" ", F.coalesce("pos", F.lit(0)).cast("string"), F.expr("transform(words, w -> cast(w as string))"))
    stats = F.concat_ws(" ", F.format_string("%.9f", F.coalesce(F.col("logl"), F.lit(0.0))), F.coalesce("heldout_sum", F.lit(0)).cast("string"))
    subtree = F.concat_ws(" ", F.lit("subtree"), F.col("block_id").cast("string"))
    alone = F.concat_ws(" ", subtree, F.lit("= leaf"), F.col("leaf_id").cast("string"), stats)
    heads = full.filter("block_id is not null").select(
        "tree_id", F.col("path").alias("block"), "path", F.when(F.col("is_leaf"), alone).otherwise(F.concat_ws("\n", F.concat_ws(" ", subtree, stats), question)).alias("text")
    )
    own = F.concat_ws(" ", F.when(F.col("is_leaf"), F.concat_ws(" ", F.lit("leaf"), F.col("leaf_id").cast("string"))).otherwise(F.lit("node")), stats)
    above = F.substring(F.col("path"), F.lit(1), (F.floor((F.length("path") - 1) / levels) * levels).cast("int"))
    inner = full.filter("path <> ''").select(
        "tree_id", above.alias("block"), "path", F.when(F.col("block_id").isNotNull(), F.concat_ws(" ", subtree, stats)).otherwise(F.concat_ws("\n", own, question)).alias("text")
    )
    every = heads.withColumn("head", F.lit(True)).unionByName(inner.withColumn("head", F.lit(False)))
    last = F.row_number().over(Window.partitionBy("tree_id", "block").orderBy(F.col("path").desc())) == 1
    value = F.concat_ws("\n", F.when(F.col("head"), F.lit(BEGIN)), "text", F.when(last, F.lit(END)))
    return every.select("tree_id", "block", "path", value.alias("value")).orderBy("tree_id", F.length("block"), "block", "path")


def parse_blocks(text: str, tree_id: int = 0) -> tuple[list[tuple[int, str, str, int, int]], list[tuple[int, str, bool, float, int]]]:
    """EDGES and (tree_id, path, is_leaf, logl, heldout_sum) of one tree's blocks; the first block is the root's.

    Blocks that nothing refers to are passed over; a reference to a block that is missing, or an unknown line, is an error.
    """
    blocks: dict[int, list[str]] = {}
    order, lines = [], None
    for line in text.split("\n"):
        if line == BEGIN:
            lines = []
        elif line == END and lines:
            number = int(lines[0].split()[1])
            blocks[number] = lines
            order.append(number)
            lines = None
        elif lines is not None:
            lines.append(line)
    edges, nodes = [], []
    open_blocks = [(order[0], "")] if order else []
    while open_blocks:
        number, top = open_blocks.pop()
        if number not in blocks:
            raise ValueError(f"block {number} is missing")
        rest, stack = iter(blocks[number]), [top]
        while stack:
            path = stack.pop()
            kind, *more = next(rest).split()
            if kind == "null":
                continue
            if kind == "subtree" and path != top:
                open_blocks.append((int(more[0]), path))
                continue
            if kind not in ("node", "leaf", "subtree"):
                raise ValueError(f"{kind!r} is no kind of node")
            leaf = kind == "leaf" or "leaf" in more
            nodes.append((tree_id, path, leaf, float(more[-2]), int(more[-1])))
            if "=" not in more:
                pos, *words = map(int, next(rest).split())
                edges += [(tree_id, path[:-1], path, pos, w) for w in words if path]
            if not leaf:
                stack += [path + "1", path + "0"]
    return edges, nodes

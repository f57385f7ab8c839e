"""Model files: trees in pre-order text, ARPA back-off models, and small parameter files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = "tree_id int, parent string, child string, pos int, word long"


def tree_lines(edges: DataFrame) -> DataFrame:
    """(tree_id, path, value): two lines a node in pre-order of paths: its kind, then the position and words that lead to it.

    A path's lexicographic order is pre-order, so lines are sorted by (tree_id, path) and nothing is gathered.
    """
    lead = edges.groupBy("tree_id", F.col("child").alias("path")).agg(F.first("pos").alias("pos"), F.sort_array(F.collect_set("word")).alias("words"))
    inner = edges.select("tree_id", F.col("parent").alias("path")).distinct().withColumn("inner", F.lit(True))
    roots = edges.select("tree_id", F.lit("").alias("path")).distinct()
    nodes = roots.join(lead, ["tree_id", "path"], "full").join(inner, ["tree_id", "path"], "left")
    kind = F.when(F.col("inner"), "node").otherwise("leaf")
    question = F.concat_ws(" ", F.coalesce(F.col("pos"), F.lit(0)).cast("string"), F.expr("transform(words, w -> cast(w as string))"))
    return nodes.select("tree_id", "path", F.concat_ws("\n", kind, question).alias("value")).orderBy("tree_id", "path")


def parse_tree(text: str, tree_id: int = 0) -> list[tuple[int, str, str, int, int]]:
    """Rows of EDGES from the text of one tree; `null` stands for no child."""
    lines, at, rows = text.split("\n"), 0, []
    stack = [""]
    while stack:
        path = stack.pop()
        kind = lines[at].strip()
        at += 1
        if kind == "null":
            continue
        if kind not in ("node", "leaf"):
            raise ValueError(f"line {at}: {kind!r} is no kind of node")
        pos, *words = map(int, lines[at].split())
        at += 1
        rows += [(tree_id, path[:-1], path, pos, w) for w in words if path]
        if kind == "node":
            stack += [path + "1", path + "0"]
    return rows


def read_tree(spark: SparkSession, text: str, tree_id: int = 0) -> DataFrame:
    return spark.createDataFrame(parse_tree(text, tree_id), EDGES)


def arpa_lines(probs: DataFrame, bows: DataFrame) -> DataFrame:
    """(ord, value): ``log10 p <tab> n-gram [<tab> log10 bow]`` of (ord, ctx, w0, p) and (ctx, bow); -99 for probability 0."""
    gram = F.concat(F.reverse("ctx"), F.array("w0"))
    rows = probs.withColumn("gram", gram).join(bows.select(F.reverse("ctx").alias("gram"), "bow"), "gram", "left")
    log = lambda c: F.format_string("%.12f", F.coalesce(F.log10(F.when(F.col(c) > 0, F.col(c))), F.lit(-99.0)))
    return rows.select("ord", F.concat_ws("\t", log("p"), F.concat_ws(" ", "gram"), F.when(F.col("bow").isNotNull(), log("bow"))).alias("value"))


def read_arpa(df: DataFrame) -> DataFrame:
    """(ord, ctx, w0, logp, log_bow) from a column `value` of ARPA lines; section heads and blank lines are passed over."""
    parts = df.filter(F.col("value").rlike(r"^-?\d")).select(F.split("value", "\t").alias("x"))
    words = parts.select(F.split(F.get("x", F.lit(1)), " ").alias("w"), F.get("x", F.lit(0)).cast("double").alias("logp"), F.get("x", F.lit(2)).cast("double").alias("log_bow"))
    n = F.size("w")
    return words.select(n.alias("ord"), F.reverse(F.slice("w", 1, n - 1)).alias("ctx"), F.element_at("w", -1).alias("w0"), "logp", "log_bow")


def arpa_file(model: DataFrame) -> DataFrame:
    """(place, value): the lines of a whole ARPA file in order of (place, value), from (ord, ctx, w0, logp, log_bow).

    A head with the number of n-grams of each order, a section for each order, and the end mark.
    """
    spark = model.sparkSession
    log = lambda c: F.format_string("%.12f", F.col(c))
    gram = F.concat_ws(" ", F.reverse("ctx"), F.col("w0"))
    lines = model.select((2 * F.col("ord") + 1).alias("place"), F.concat_ws("\t", log("logp"), gram, F.when(F.col("log_bow").isNotNull(), log("log_bow"))).alias("value"))
    sizes = model.groupBy("ord").agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.select(F.lit(1).alias("place"), F.concat(F.lit("ngram "), F.col("ord").cast("string"), F.lit("="), F.col("n").cast("string")).alias("value"))
    heads = sizes.select((2 * F.col("ord")).alias("place"), F.concat(F.lit("\n\\"), F.col("ord").cast("string"), F.lit("-grams:")).alias("value"))
    marks = spark.createDataFrame([(0, "\\data\\"), (1 << 20, "\n\\end\\")], "place int, value string")
    return marks.unionByName(totals).unionByName(heads).unionByName(lines).orderBy("place", "value")


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files at `path` that make one file if they are put together by name."""
    lines.select("value").write.text(path)


def discount_lines(discounts: DataFrame) -> DataFrame:
    """(ord, value): the discount file of each order as one text, from (ord, mincount, d1, d2, d3)."""
    names = {"mincount": "%d", "d1": "%.12f", "d2": "%.12f", "d3": "%.12f"}
    words = dict(zip(names, ("mincount", "discount1", "discount2", "discount3+")))
    return discounts.select("ord", F.concat_ws("\n", *(F.format_string(f"{words[c]} {f}", F.col(c)) for c, f in names.items())).alias("value"))


def read_discounts(lines: DataFrame) -> DataFrame:
    """(ord, mincount, d1, d2, d3) from texts of `discount_lines`; words that are missing give null."""
    number = lambda name: F.regexp_extract("value", rf"(?m)^{name} (\S+)$", 1)
    found = lambda name, kind: F.when(number(name) != "", number(name).cast(kind))
    return lines.select("ord", found("mincount", "int").alias("mincount"), *(found(f"discount{k}", "double").alias(f"d{k[0]}") for k in ("1", "2", r"3\+")))


def tree_paths(lines: DataFrame) -> DataFrame:
    """EDGES from (tree_id, path, value) as `tree_lines` gives it: each node's line has its path, so rows are read apart."""
    words = F.split(F.element_at(F.split("value", "\n"), -1), " ")
    rows = lines.filter("path <> ''").select("tree_id", "path", words[0].cast("int").alias("pos"), F.explode(F.slice(words, 2, F.size(words))).alias("word"))
    return rows.select("tree_id", F.expr("substr(path, 1, length(path) - 1)").alias("parent"), F.col("path").alias("child"), "pos", F.col("word").cast("long").alias("word"))

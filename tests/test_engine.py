import glob
import math
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from thicket.operators import discounts, evaluate, forest, models, smoothing, split
from thicket.plans.oracles import ORACLE_SQL
from thicket.plans.queries import QUERIES, TREE
from thicket.sources import blocks, formats

DATA = "/root/testdata/sf0.001"


def rows(df):
    columns = sorted(df.columns)
    plain = lambda v: None if pd.isna(v) else round(float(v), 6) if not isinstance(v, str) else v
    return sorted((tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


def test_exchange_reaches_the_worked_split():
    elem, word, cnt = np.array([(1, 1, 4), (1, 2, 1), (2, 1, 3), (3, 2, 5), (4, 2, 2)]).T
    side, gain = split.exchange(elem, word, cnt, {e: e % 2 for e in range(1, 5)})
    assert side == {1: 1, 2: 1, 3: 0, 4: 0}
    assert gain == pytest.approx(7.349688, abs=1e-6)


def test_leaf_probability_and_unseen_history(spark):
    hist = spark.createDataFrame([(0, "0", 1, 3), (0, "0", 2, 1)], "tree_id int, path string, w0 long, cnt long")
    test = spark.createDataFrame(
        [([9], 1, 0.5, 0.1, "0", True), ([9], 2, 0.3, 0.1, "0", True), ([9], 3, 0.2, 0.1, "0", True), ([8], 1, 0.5, 0.1, "", False)],
        "ctx array<long>, w0 long, p_short double, p_full double, path string, found boolean",
    ).selectExpr("0 as tree_id", "*", "false as short")
    found = forest.score(test, hist, smoothing.Discount(d=(0.6, 1.0, 1.4))).select("found", "w0", "prob", "provenance").collect()
    got = {(r[0], r[1]): (round(r[2], 6), r[3]) for r in found}
    assert got == {(True, 1): (0.65, "seen"), (True, 2): (0.25, "seen"), (True, 3): (0.1, "unseen_seen"), (False, 1): (0.1, "unseen_history")}


@pytest.mark.parametrize("threshold, left", [(0.0, 5), (0.12, 1), (0.125, 1)])
def test_pruning(spark, threshold, left):
    nodes = [(0, "", False, -10.0, 10), (0, "0", True, -4.0, 5), (0, "1", False, -4.5, 4), (0, "10", True, -2.5, 2), (0, "11", True, -1.5, 2)]
    made = forest.potentials(spark.createDataFrame(nodes, "tree_id int, path string, is_leaf boolean, logl double, heldout_sum long"))
    got = {r["path"]: round(r["potential"], 6) for r in made.collect()}
    assert (got[""], got["1"]) == (0.111111, 0.125)
    assert forest.prune(made, threshold).count() == left


def test_perplexity_of_the_published_log_probability(spark):
    p = 10 ** (-174163 / 82430)
    found = evaluate.perplexity(spark.createDataFrame([("</s>", 3761, p), ("a", 78669, p)], "w0 string, cnt long, prob double")).first()
    assert (found["sentences"], found["words"], round(found["ppl"], 2), round(found["ppl1"], 2)) == (3761, 78669, 129.68, 163.63)


def test_uniform_mixture(spark):
    scored = spark.createDataFrame([(0, "c", "w", 0.2), (1, "c", "w", 0.4), (2, "c", "w", 0.9)], "tree_id int, ctx string, w0 string, prob double")
    assert evaluate.mix(scored).first()["prob"] == pytest.approx(0.5)


def test_hash_uniforms(spark):
    assert [split._uniform32(7, k) for k in range(3)] == [1184038712, 479964857, 1840184614]


def test_forest_is_the_same_in_any_partitioning(spark):
    train = spark.createDataFrame([([a, b], (a * 3 + b) % 4 + 1, a + 2 * b) for a in range(1, 6) for b in range(1, 6)], "ctx array<long>, w0 long, cnt long")
    grown = [{tuple(r) for r in forest.grow(train.repartition(n), 2, 3, 5).collect()} for n in (1, 3)]
    assert grown[0] == grown[1] and grown[0]
    assert {r["tree_id"] for r in forest.tree_stats(spark.createDataFrame(sorted(grown[0]), forest.EDGES)).collect()} <= {0, 1}


def test_tree_text_with_missing_child():
    assert formats.parse_tree("node\n0\nleaf\n0 1 2\nnull") == [(0, "", "0", 0, 1), (0, "", "0", 0, 2)]
    with pytest.raises(ValueError):
        formats.parse_tree("twig\n0")


def test_entry(spark):
    ppl = {r["model"]: r["ppl"] for r in entry.entry(spark).collect()}
    assert len(ppl) == 7 and ppl["forest"] <= sum(ppl[str(k)] for k in range(5)) / 5 + 1e-9
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_shallow_growth_tries_no_more_nodes_than_allowed(spark):
    sizes = {r.tree_id: r.nodes - r.leaves for r in QUERIES["shallow_growth"](spark, DATA).collect()}
    assert sizes and all(inner <= 3 for inner in sizes.values())


def test_natural_and_good_turing_by_hand(spark):
    counts = spark.createDataFrame([(1, [], "a", 3), (1, [], "b", 1), (1, [], "c", 1), (1, [], "d", 2)], "ord int, ctx array<string>, w0 string, cnt long")
    natural = {r.w0: r.p for r in discounts.train_natural(counts, 1).prob(counts).collect()}
    # n = 7, q = 4: (c + 1) * 4 and 20 / 4 over 64
    assert natural == pytest.approx({"a": 21 / 64, "b": 13 / 64, "c": 13 / 64, "d": 17 / 64})
    # n1..n3 = 2, 1, 1 and gt_max 1: A = 2 * 1 / 2 = 1 leaves nothing to divide by, so the factor is 1
    assert [r.factor for r in discounts.good_turing(counts, 1).collect()] == [1.0]
    assert discounts.good_turing(counts.limit(0)).count() == 0


def test_tagged_counts(spark):
    rows = [(2, ["a"], "#0", 4), (2, ["a"], "#1", 3), (2, ["a"], "#3", 2), (2, ["a"], "plain", 2)]
    found = discounts.tagged_stats(spark.createDataFrame(rows, "ord int, ctx array<string>, w0 string, cnt long"), "#").first()
    assert (found.total, found.types, found.min2, found.min3) == (4 + 3 + 6 + 2, 6, 3, 2)


def test_entropy_pruning_drops_what_the_shorter_context_says_as_well(spark):
    rows = [(["h"], "same", 0.3, 0.3, 0.5), (["h"], "other", 0.4, 0.1, 0.5)]
    found = {r.w0: r for r in models.entropy_prune(spark.createDataFrame(rows, "ctx array<string>, w0 string, p double, p_low double, p_ctx double"), 0.01).collect()}
    # without "other": back-off weight (1 - 0.3) / (1 - 0.3) = 1 instead of 0.3 / 0.6
    rise = math.exp(-0.5 * (0.4 * (math.log(0.1) - math.log(0.4)) + 0.3 * (0 - math.log(0.5)))) - 1
    assert found["other"].delta == pytest.approx(rise) and found["other"].kept


def test_generation_ends_and_repeats(spark):
    grams = spark.createDataFrame([("<s>", "a", 1), ("a", "b", 1), ("b", "a", 1), ("b", "</s>", 1)], "h1 string, w0 string, weight long")
    first = sorted(models.generate(grams, 5, 1, 6).collect())
    assert first == sorted(models.generate(grams.repartition(3), 5, 1, 6).collect())
    for sentence in range(5):
        words = [r.word for r in first if r.sent_id == sentence]
        assert words[0] == "a" and (words[-1] == "</s>" or len(words) == 6)


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_blocks_round_trip(spark, levels):
    edges = spark.createDataFrame(TREE, formats.EDGES)
    nodes = [(0, "", False, -10.0, 10), (0, "0", False, -4.5, 4), (0, "00", True, -2.5, 2), (0, "01", True, -1.5, 2), (0, "1", True, -4.0, 5)]
    table = spark.createDataFrame(nodes, "tree_id int, path string, is_leaf boolean, logl double, heldout_sum long")
    lines = [r.value for r in blocks.block_lines(edges, table, levels).collect()]
    text = "\n".join(lines)
    assert text.count(blocks.BEGIN) == text.count(blocks.END) == {1: 2, 2: 1, 5: 1}[levels]
    found_edges, found_nodes = blocks.parse_blocks(text)
    assert sorted(found_edges) == sorted(TREE) and sorted(found_nodes) == nodes


def test_blocks_of_a_lone_leaf_and_missing_blocks(spark):
    alone = "\n".join([blocks.BEGIN, "subtree -1 = leaf 1 -2.5 3", blocks.END])
    assert blocks.parse_blocks(alone) == ([], [(0, "", True, -2.5, 3)])
    assert blocks.parse_blocks("") == ([], [])
    with pytest.raises(ValueError):
        blocks.parse_blocks("\n".join([blocks.BEGIN, "subtree -1 -2 3", "0", "subtree -2 0 0", "null", blocks.END]))


def test_documents_are_counted_over_all_words(spark):
    """Counts and counts of counts by brute force, with no word turned into <unk>; perplexity over the same words."""
    sents = [["<s>", *words, "</s>"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect() for line in (r[0] or "").split("\n") if (words := [w for w in re.split(r"[ \t\n\x0b\f\r]+", line) if w])]
    want = Counter((k, w[i], w[i - 1] if k > 1 else None, w[i - 2] if k > 2 else None) for w in sents for i in range(len(w)) for k in (1, 2, 3) if i >= k - 1)
    assert {(r["ord"], r["w0"], r["h1"], r["h2"]): r["cnt"] for r in QUERIES["ngram_counts_all_words"](spark, DATA).collect()} == want
    coc = Counter((g[0], n) for g, n in want.items())
    got = {r["ord"]: r for r in QUERIES["counts_of_counts_all_words"](spark, DATA).collect()}
    assert all(got[k][f"n{n}"] == coc[k, n] for k in (1, 2, 3) for n in (1, 2, 3, 4))
    assert {(r["ord"], r["r"]): r["n_r"] for r in QUERIES["good_turing_discounts_all_words"](spark, DATA).collect()}[3, 1] == coc[3, 1]
    y = {r["ord"]: r["y"] for r in QUERIES["kn_discounts_all_words"](spark, DATA).collect()}
    assert y[3] == pytest.approx(coc[3, 1] / (coc[3, 1] + 2 * coc[3, 2]), abs=1e-6)
    found = QUERIES["kn_perplexity"](spark, DATA).first()
    assert (found["sentences"], found["words"], found["zeroprobs"]) == (len(sents), sum(len(w) - 2 for w in sents), 0)
